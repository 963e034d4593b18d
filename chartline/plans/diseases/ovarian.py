from ..disease import Disease

# --- fixed values -----------------------------------------------------------
ABDOMINAL = ["ABDOMINAL_BLOATING", "ABDOMINAL_PAIN", "ABDOMINAL_MASS", "ASCITES", "EARLY_SATIETY"]
CARDINALS = "has_bloating + has_satiety + has_pain + has_urinary"

DISEASE = Disease(
    name="ovarian",
    groups={
        "bloating": ["ABDOMINAL_BLOATING"], "satiety": ["EARLY_SATIETY"], "pain": ["ABDOMINAL_PAIN"], "urinary": ["URINARY_SYMPTOMS"], "gi": ["GI_SYMPTOMS"], "bleeding": ["GYNAECOLOGICAL_BLEEDING"],
        "postmenopausal": ["POSTMENOPAUSAL"], "cyst": ["OVARIAN_CYST"], "ascites": ["ASCITES"], "mass": ["ABDOMINAL_MASS"], "weight_loss": ["WEIGHT_LOSS"], "fatigue": ["FATIGUE"],
        "family_hx": ["FAMILY_HISTORY"], "hrt": ["HRT"], "obesity": ["OBESITY"], "reproductive_hx": ["REPRODUCTIVE_HISTORY"], "imaging": ["IMAGING"], "gynae_proc": ["GYNAE_PROCEDURES"],
        "investigation": ["IMAGING", "GYNAE_PROCEDURES", "OTHER_PROCEDURES"], "abdominal": ABDOMINAL, "gynae": ["GYNAECOLOGICAL_BLEEDING", "VAGINAL_DISCHARGE", "OVARIAN_CYST"],
        "constitutional": ["WEIGHT_LOSS", "FATIGUE", "SYSTEMIC", "ANAEMIA"], "vte": ["DVT", "PULMONARY_EMBOLISM"],
        "symptom": ["ABDOMINAL_PAIN", "ABDOMINAL_BLOATING", "URINARY_SYMPTOMS", "GI_SYMPTOMS", "EARLY_SATIETY"],
        "contraceptive": ["ORAL_CONTRACEPTIVE"], "nsaid": ["NSAIDS"], "opioid": ["OPIOID_ANALGESICS"], "ppi": ["PPI"], "antispasmodic": ["GI_ANTISPASMODICS"], "laxative": ["LAXATIVES"],
        "antiemetic": ["ANTIEMETICS"], "iron": ["IRON_SUPPLEMENTS"], "diuretic": ["DIURETICS"], "anticoagulant": ["ANTICOAGULANTS"], "uti_antibiotics": ["UTI_ANTIBIOTICS"],
    },
    labs={
        "hb": (["HAEMATOLOGY"], "haemoglobin|hemoglobin"), "crp": (["INFLAMMATORY"], r"CRP|C[\s-]*reactive"), "albumin": (["METABOLIC"], "albumin"),
        "platelets": (["HAEMATOLOGY"], r"Platelet\s+count|platelets"), "egfr": (["RENAL"], r"eGFR|glomerular\s+filtration"), "esr": (["INFLAMMATORY"], r"Erythrocyte\s+sedimentation|ESR"),
        "alp": (["LIVER"], r"Alkaline\s+phosphatase|ALP"), "ldh": (["CANCER_MARKER"], r"lactate\s+dehydrogenase|LDH"), "calcium": (["ELECTROLYTES"], "calcium"),
    },
    lab_flags={
        "hb_anaemic": "hb_latest < 120", "hb_severe": "hb_latest < 100", "hb_declining": "hb_first - hb_latest > 5", "crp_elevated": "crp_latest > 10", "crp_high": "crp_max > 30",
        "albumin_low": "albumin_latest < 35", "platelets_high": "platelets_latest > 400", "platelets_very_high": "platelets_latest > 600", "egfr_low": "egfr_latest < 60",
        "egfr_declining": "egfr_first - egfr_latest > 10", "esr_elevated": "esr_latest > 30", "alp_elevated": "alp_latest > 130", "ldh_elevated": "ldh_latest > 250", "calcium_high": "calcium_latest > 2.6",
    },
    # --- end of fixed values: what follows is combined from them, but for weights, orders and vocabularies ---
    flags={
        "cardinals_2plus": f"{CARDINALS} >= 2", "over50_cardinal": f"age >= 50 AND {CARDINALS} >= 1", "over50_2plus": "age >= 50 AND cardinals_2plus = 1",
        "persistent_bloating": "b_bloating >= 2", "persistent_pain": "b_pain >= 2", "persistent_urinary": "b_urinary >= 2", "persistent_satiety": "b_satiety >= 2",
        "ibs_mimic": "has_gi = 1 AND has_bloating = 1 AND has_pain = 1", "ibs_mimic_no_investigation": "ibs_mimic = 1 AND has_investigation = 0",
        "uti_mimic": "has_urinary = 1 AND n_uti_antibiotics >= 1", "uti_mimic_recurrent": "has_urinary = 1 AND n_uti_antibiotics >= 2", "postmeno_bleeding": "has_bleeding = 1 AND age >= 55",
        "postmeno_bleeding_pain": "postmeno_bleeding = 1 AND has_pain = 1", "classic_triad": "has_bloating = 1 AND has_pain = 1 AND has_urinary = 1", "classic_triad_over50": "classic_triad = 1 AND age >= 50",
        "cyst_with_pain": "has_cyst = 1 AND has_pain = 1", "cyst_with_bloating": "has_cyst = 1 AND has_bloating = 1", "cyst_complex": "has_cyst = 1 AND cardinals_2plus = 1",
        "ascites_or_mass": "has_ascites = 1 OR has_mass = 1", "ascites_and_mass": "has_ascites = 1 AND has_mass = 1", "late_stage_triad": "has_mass = 1 AND has_ascites = 1 AND has_weight_loss = 1",
        "peak_age": "age BETWEEN 55 AND 75", "family_plus_symptoms": f"has_family_hx = 1 AND {CARDINALS} >= 1", "family_plus_age": "has_family_hx = 1 AND age >= 50",
        "anaemic_with_pain": "hb_anaemic = 1 AND has_pain = 1", "anaemic_with_fatigue": "hb_anaemic = 1 AND has_fatigue = 1", "albumin_low_ascites": "albumin_low = 1 AND has_ascites = 1",
        "platelets_with_symptoms": f"platelets_high = 1 AND {CARDINALS} >= 1", "ldh_with_mass": "ldh_elevated = 1 AND has_mass = 1", "aggressive_pair": "alp_elevated + hb_anaemic + albumin_low >= 2",
        "aggressive_trio": "alp_elevated + hb_anaemic + albumin_low >= 3", "symptoms_no_imaging": "cardinals_2plus = 1 AND has_imaging = 0", "pain_with_opioid": "has_pain = 1 AND has_opioid = 1",
        "pain_escalation": "has_nsaid = 1 AND has_opioid = 1", "gi_multi_treated": "has_ppi + has_antispasmodic + has_laxative + has_antiemetic >= 2",
        "gi_treated_no_investigation": "has_ppi + has_antispasmodic + has_laxative + has_antiemetic >= 1 AND has_investigation = 0", "iron_with_declining_hb": "has_iron = 1 AND hb_declining = 1",
        "diuretic_with_ascites": "has_diuretic = 1 AND has_ascites = 1", "vte_with_symptoms": f"has_vte = 1 AND {CARDINALS} >= 1",
    },
    scores={"cardinal_count": CARDINALS, "persistent_count": "persistent_bloating + persistent_pain + persistent_urinary + persistent_satiety", "aggressive_score": "alp_elevated + hb_anaemic + albumin_low"},
    systems={"abdominal": ["abdominal"], "gynae": ["gynae"], "constitutional": ["constitutional"]},
    trends=["bloating", "pain", "urinary", "satiety", "abdominal", "gynae", "constitutional", "imaging"],
    onsets=["bloating", "pain", "satiety", "urinary", "mass", "ascites", "cyst", "bleeding", "gi", "imaging", "constitutional"],
    sequences=[("bloating", "imaging", 60), ("bloating", "imaging", 180), ("pain", "imaging", 90), ("mass", "imaging", 30), ("ascites", "imaging", 30), ("cyst", "imaging", 60),
               ("bleeding", "gynae_proc", 60), ("bloating", "gynae_proc", 120), ("urinary", "imaging", 90), ("symptom", "imaging", 36500)],
    products={
        "bloatB_mass": ["b_bloating", "has_mass"], "bloatB_ascites": ["b_bloating", "has_ascites"], "painB_mass": ["b_pain", "has_mass"], "bloatB_platelets": ["b_bloating", "platelets_high"],
        "painB_platelets": ["b_pain", "platelets_high"], "constitB_albumin": ["b_constitutional", "albumin_low"], "bloatB_family": ["b_bloating", "has_family_hx"], "cyst_painB": ["has_cyst", "b_pain"],
        "mass_ascites": ["has_mass", "has_ascites"], "cardinals_platelets": ["cardinal_count", "platelets_high"],
    },
    weights={
        "ABDOMINAL_MASS": 3.0, "ASCITES": 3.0, "ABDOMINAL_BLOATING": 2.0, "EARLY_SATIETY": 2.0, "ABDOMINAL_PAIN": 1.5, "URINARY_SYMPTOMS": 1.5, "GI_SYMPTOMS": 1.0, "OVARIAN_CYST": 2.5,
        "GYNAECOLOGICAL_BLEEDING": 1.5, "POSTMENOPAUSAL": 1.0, "GYNAECOLOGICAL_DX": 1.0, "WEIGHT_LOSS": 2.0, "FATIGUE": 1.0, "SYSTEMIC": 1.5, "ANAEMIA": 1.5, "IMAGING": 1.0, "GYNAE_PROCEDURES": 2.0,
        "OTHER_PROCEDURES": 1.0, "FAMILY_HISTORY": 2.0, "DVT": 1.5, "PULMONARY_EMBOLISM": 1.5, "HRT": 0.5, "OBESITY": 0.5, "HYDRONEPHROSIS": 1.0,
    },
    symptoms=["ABDOMINAL_MASS", "ASCITES", "ABDOMINAL_BLOATING", "EARLY_SATIETY", "ABDOMINAL_PAIN", "GI_SYMPTOMS", "GYNAECOLOGICAL_BLEEDING", "VAGINAL_DISCHARGE", "URINARY_SYMPTOMS", "WEIGHT_LOSS",
              "FATIGUE", "SYSTEMIC"],
    peak_age=65.0,
    vocabularies={
        "investigation": ["IMAGING", "GYNAE_PROCEDURES", "MICROBIOLOGY"],
        "lab": ["HAEMATOLOGY", "RENAL", "INFLAMMATORY", "METABOLIC", "LIVER", "HORMONAL", "CANCER_MARKER", "ELECTROLYTES", "COAGULATION", "GI_INVESTIGATION", "OTHER_LAB", "BMI", "BODY_WEIGHT",
                "IDEAL_BODY_WEIGHT", "SYSTOLIC_BP", "DIASTOLIC_BP", "HEART_RATE"],
        "decay": ["ABDOMINAL_MASS", "ASCITES", "ABDOMINAL_BLOATING", "EARLY_SATIETY", "ABDOMINAL_PAIN", "GI_SYMPTOMS", "GYNAECOLOGICAL_BLEEDING", "WEIGHT_LOSS", "FATIGUE", "URINARY_SYMPTOMS"],
    },
)
