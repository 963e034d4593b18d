from ..disease import Disease

# --- fixed values -----------------------------------------------------------
POSTMENO = "(has_menopause = 1 OR has_atrophic_vag = 1 OR age >= 55)"
CARDIO = "has_cvd + has_ihd + has_htn + has_hyperchol + has_dm"
SYMPTOMS = "has_lump + has_pain + has_nipple"
LIFESTYLE = "has_smoking + has_alcohol + has_physact + has_bmi + has_weight_loss_meds"

DISEASE = Disease(
    name="breast",
    groups={
        "lump": ["SYMPTOM_BREAST_LUMP"], "pain": ["SYMPTOM_BREAST_PAIN"], "nipple": ["SYMPTOM_NIPPLE"], "benign": ["BREAST_BENIGN"], "cvd": ["COMORBID_CVD"], "ihd": ["COMORBID_IHD"],
        "htn": ["COMORBID_HTN"], "hyperchol": ["COMORBID_HYPERCHOL"], "dm": ["COMORBID_DM"], "dm_foot": ["COMORBID_DM_FOOT"], "dm_eye": ["COMORBID_DM_EYE"], "tah": ["REPRO_TAH"],
        "tah_bso": ["REPRO_TAH_BSO"], "menopause": ["REPRO_MENOPAUSE"], "atrophic_vag": ["REPRO_ATROPHIC_VAG"], "menstrual": ["REPRO_MENSTRUAL_FLOW"], "pms": ["REPRO_PMS"], "parity": ["REPRO_PARITY"],
        "famhx_breast": ["FAMHX_BREAST_OVARIAN"], "famhx_other": ["FAMHX_OTHER_CANCERS"], "brca": ["HEREDITARY_BRCA"], "hodgkin": ["HISTORY_HODGKIN_RT"], "oophorectomy": ["HISTORY_OOPHORECTOMY"],
        "ovarian": ["OVARIAN_CONDITIONS"], "smoking": ["LIFE_SMOKING"], "alcohol": ["LIFE_ALCOHOL", "LIFE_ALC_EDU", "LIFE_ALC_SCREEN"], "diet": ["LIFE_DIET"], "physact": ["LIFE_PHYSACT"],
        "bmi": ["LIFE_BMI", "LIFE_WEIGHT_SX"], "hrt": ["HRT"], "oc": ["OC"], "smoking_meds": ["SMOKING_CESSATION"], "weight_loss_meds": ["WEIGHT_LOSS_MEDS"], "antidepressants": ["ANTIDEPRESSANTS"],
        "antipsychotics": ["ANTIPSYCHOTICS"], "anxiolytics": ["ANXIOLYTICS_HYPNOTICS"],
        "mental_health": ["COMORBID_DEPRESSION", "COMORBID_DEPRESSION_MILD", "COMORBID_DEPRESSION_MOD", "COMORBID_DEPRESSION_SAD", "COMORBID_DEPRESSION_SX", "COMORBID_INSOMNIA", "COMORBID_HADS",
                          "COMORBID_MH_CPA", "COMORBID_MH_CARE_PLAN", "COMORBID_PSYCH_STRESS", "COMORBID_PSYCH_STRESS_HOME", "COMORBID_PSYCH_BEREAVEMENT", "COMORBID_MEMORY_LOSS"],
    },
    labs={"hba1c": (["LAB_HBA1C"], ".")},
    lab_flags={"hba1c_diabetic": "hba1c_latest >= 48", "hba1c_prediabetic": "hba1c_latest >= 42 AND hba1c_latest < 48", "hba1c_poor_control": "hba1c_latest >= 58"},
    # --- end of fixed values: what follows is combined from them, but for weights, orders and vocabularies ---
    flags={
        "cardiometabolic_3plus": f"{CARDIO} >= 3", "metabolic_syndrome": f"{CARDIO} >= 2", "tah_no_bso": "has_tah = 1 AND has_tah_bso = 0", "postmenopausal": POSTMENO,
        "early_menopause": "has_menopause = 1 AND age < 50", "late_menstruation": "has_menstrual = 1 AND age >= 50", "hrt_multi": "n_hrt >= 3", "hrt_postmeno": "has_hrt = 1 AND postmenopausal = 1",
        "oc_multi": "n_oc >= 3", "oc_premeno": "has_oc = 1 AND age < 50", "strong_hereditary": "has_brca = 1 OR has_famhx_breast = 1 OR has_famhx_other = 1", "brca_over40": "has_brca = 1 AND age >= 40",
        "famhx_postmeno": "has_famhx_breast = 1 AND postmenopausal = 1", "famhx_premeno": "has_famhx_breast = 1 AND age < 50", "any_symptom": f"{SYMPTOMS} >= 1", "multi_symptom": f"{SYMPTOMS} >= 2",
        "any_finding": f"{SYMPTOMS} + has_benign >= 1", "lump_over50": "has_lump = 1 AND age >= 50", "lump_over65": "has_lump = 1 AND age >= 65", "lump_postmeno": "has_lump = 1 AND postmenopausal = 1",
        "lump_famhx": "has_lump = 1 AND has_famhx_breast = 1", "lump_hrt": "has_lump = 1 AND has_hrt = 1", "lump_hereditary": "has_lump = 1 AND strong_hereditary = 1",
        "nipple_postmeno": "has_nipple = 1 AND postmenopausal = 1", "smoking_treated": "has_smoking = 1 AND has_smoking_meds = 1", "lifestyle_3plus": f"{LIFESTYLE} >= 3",
        "mental_health_treated": "has_mental_health = 1 AND has_antidepressants + has_antipsychotics + has_anxiolytics >= 1", "lump_postmeno_famhx": "lump_postmeno = 1 AND has_famhx_breast = 1",
        "lump_age65_hereditary": "has_lump = 1 AND age >= 65 AND strong_hereditary = 1", "brca_famhx_age50": "has_brca = 1 AND has_famhx_breast = 1 AND age >= 50",
    },
    scores={
        "cardiometabolic": CARDIO, "repro_pathway": "has_tah + has_tah_bso + has_menopause + has_atrophic_vag + has_menstrual + has_pms + has_parity", "symptom_burden": SYMPTOMS,
        "hereditary_load": "has_brca + has_famhx_breast + has_famhx_other", "lifestyle_burden": LIFESTYLE, "diabetes_care": "has_dm_foot + has_dm_eye",
        "risk_score": "CAST(age >= 50 AS INT) + CAST(age >= 65 AS INT) + 0.5 * CAST(age >= 75 AS INT) + 0.8 * hba1c_diabetic + 0.8 * metabolic_syndrome + 0.5 * has_alcohol + 0.5 * has_smoking - has_tah_bso "
                      "- 0.5 * early_menopause + 0.5 * late_menstruation + 2.0 * has_famhx_breast + has_hrt + 0.5 * hrt_postmeno + 1.5 * has_hodgkin + 0.3 * has_oc + 3.0 * has_brca "
                      "+ 0.5 * has_famhx_other + 2.5 * has_lump + 1.5 * has_nipple + 0.5 * has_pain + 0.3 * has_benign + multi_symptom + lump_postmeno - 1.5 * has_oophorectomy",
    },
    systems={"breast": ["lump", "pain", "nipple"], "hormonal": ["hrt", "oc", "menopause"], "cardiometabolic": ["cvd", "ihd", "htn", "hyperchol", "dm"]},
    trends=["lump", "pain", "nipple", "benign", "hrt", "oc", "menopause", "bmi", "smoking", "alcohol"],
    onsets=["lump", "pain", "nipple", "benign", "famhx_breast", "hrt", "menopause"],
    products={"lump": ["has_lump"], "famhx": ["has_famhx_breast"], "hrt": ["has_hrt"], "risk": ["risk_score"], "lump_hereditary": ["has_lump", "strong_hereditary"]},
    symptoms=["COMORBID_DEPRESSION", "COMORBID_INSOMNIA", "COMORBID_MEMORY_LOSS", "COMORBID_HADS", "COMORBID_FLU_LIKE", "COMORBID_HAYFEVER", "COMORBID_PSYCH_STRESS", "COMORBID_PSYCH_BEREAVEMENT",
              "REPRO_MENOPAUSE", "REPRO_PMS", "REPRO_MENSTRUAL_FLOW", "LIFE_BMI", "LIFE_WEIGHT_SX"],
    peak_age=65.0,
    vocabularies={"decay": ["LIFE_BMI", "LIFE_SMOKING", "LIFE_ALCOHOL", "COMORBID_DEPRESSION", "COMORBID_INSOMNIA", "REPRO_MENOPAUSE", "HRT", "OC"]},
)
