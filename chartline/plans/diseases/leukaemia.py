from ..disease import Disease

# --- fixed values -----------------------------------------------------------
SUSPICION = ("CASE WHEN age >= 60 THEN 1 ELSE 0 END + 3 * blasts_present + 2 * lymphocytosis + 2 * pancytopenia + immunoparesis_2plus"
             " + has_blood_abn + has_lymphad + has_bsym + has_bleeding + has_infection")
BLOOD, HAEM = ["KEY_BLOOD_TESTS"], ["HAEMATOLOGY_INVESTIGATIONS"]

DISEASE = Disease(
    name="leukaemia",
    groups={
        "lymphad": ["LYMPHADENOPATHY"], "bsym": ["B_SYMPTOMS"], "infection": ["INFECTION"], "bleeding": ["BLEEDING_BRUISING"], "bone_pain": ["BONE_PAIN"],
        "skin": ["SKIN_LYMPHOPROLIFERATIVE"], "blood_abn": ["BLOOD_COUNT_ABNORMALITIES"], "gi": ["GI_SYMPTOMS"], "haem_inv": HAEM, "lymph_proc": ["LYMPH_NODE_PROCEDURE"],
        "imaging": ["IMAGING"], "key_blood": BLOOD, "autoimmune": ["AUTOIMMUNE_SCREEN"],
        "symptom": ["INFECTION", "BLEEDING_BRUISING", "B_SYMPTOMS", "BONE_PAIN", "LYMPHADENOPATHY", "SKIN_LYMPHOPROLIFERATIVE"],
        "antibiotics": ["ANTIBIOTICS"], "antibiotic_immuno": ["ANTIBIOTIC_IMMUNOCOMPROMISE"], "antifungals": ["ANTIFUNGALS_ORAL_SYSTEMIC"], "antivirals": ["ANTIVIRALS_SYSTEMIC"],
        "steroids": ["CORTICOSTEROIDS_SYSTEMIC"], "iron": ["IRON_SUPPLEMENTS"], "tranexamic": ["TRANEXAMIC_ACID"], "allopurinol": ["ALLOPURINOL_URIC_ACID"],
        "oral_ulcer": ["ORAL_ULCER_INFECTION_TREATMENT"], "antihistamines": ["ANTIHISTAMINES_PRURITUS"],
    },
    labs={
        "wbc": (BLOOD, r"(?:total\s+)?white\s+(?:cell|blood\s+cell)\s+count|leucocyte\s+count|^WBC\b"), "lymph": (BLOOD, r"lymphocyte\s+count|absolute\s+lymphocyte"),
        "neut": (BLOOD, r"neutrophil\s+count|absolute\s+neutrophil"), "hb": (BLOOD, "haemoglobin|hemoglobin"), "plt": (BLOOD, r"platelet\s+count|platelets"),
        "blasts": ([], r"blast\s+cell|blasts"), "luc": ([], r"large\s+unstained\s+cells|^LUC\b"), "reticulocyte": (BLOOD, "reticulocyte"),
        "ldh": (HAEM, r"lactate\s+dehydrogenase|^LDH\b"), "b2m": (HAEM, r"beta[\s-]*2[\s-]*microglobulin"), "esr": (HAEM, r"Erythrocyte\s+sedimentation|^ESR\b"),
        "crp": (HAEM, r"C[\s-]*reactive\s+protein|CRP"), "viscosity": (HAEM, r"plasma\s+viscosity"), "inr": (HAEM, r"international\s+normalised\s+ratio|^INR\b"),
        "pt": (HAEM, r"prothrombin\s+time|^PT\b"), "aptt": (HAEM, r"(?:activated\s+)?partial\s+thromboplastin\s+time|^APTT\b"),
        "igm": (HAEM, r"Immunoglobulin\s*M\b|^IgM\b"), "iga": (HAEM, r"Immunoglobulin\s*A\b|^IgA\b"), "igg": (HAEM, r"Immunoglobulin\s*G\b|^IgG\b"), "paraprotein": (HAEM, "paraprotein"),
    },
    lab_flags={
        "wbc_high": "wbc_latest > 11", "wbc_very_high": "wbc_latest > 30", "wbc_extreme": "wbc_max > 50", "wbc_low": "wbc_latest < 4", "lymphocytosis": "lymph_latest > 5",
        "lymphocytosis_high": "lymph_latest > 10", "lymphocytosis_extreme": "lymph_max > 20", "lymph_low": "lymph_latest < 1", "neutropenia": "neut_latest < 1.5",
        "severe_neutropenia": "neut_latest < 0.5", "hb_low": "hb_latest < 120", "hb_severe": "hb_latest < 80", "hb_min_low": "hb_min < 100", "thrombocytopenia": "plt_latest < 150",
        "thrombocytopenia_severe": "plt_latest < 50", "thrombocytopenia_critical": "plt_min < 20", "thrombocytosis": "plt_latest > 450", "blasts_present": "blasts_latest > 0",
        "blasts_high": "blasts_latest > 5", "blasts_very_high": "blasts_latest > 20", "ldh_elevated": "ldh_latest > 250", "ldh_high": "ldh_latest > 500", "b2m_elevated": "b2m_latest > 2.5",
        "esr_elevated": "esr_latest > 30", "esr_high": "esr_latest > 50", "crp_elevated": "crp_latest > 10", "crp_high": "crp_max > 30", "inr_elevated": "inr_latest > 1.5",
        "pt_elevated": "pt_latest > 15", "aptt_elevated": "aptt_latest > 35", "igg_low": "igg_latest < 6", "iga_low": "iga_latest < 0.7", "igm_low": "igm_latest < 0.4",
    },
    # --- end of fixed values: what follows is combined from them, but for weights, orders and vocabularies ---
    flags={
        "coagulopathy": "inr_elevated = 1 OR pt_elevated = 1 OR aptt_elevated = 1", "immunoparesis_2plus": "igg_low + iga_low + igm_low >= 2",
        "bicytopenia": "hb_low + thrombocytopenia + neutropenia >= 2", "pancytopenia": "hb_low + thrombocytopenia + neutropenia >= 3",
        "cardinals_2plus": "has_lymphad + has_bsym + has_infection + has_bleeding + has_bone_pain + has_skin >= 2",
        "cardinals_3plus": "has_lymphad + has_bsym + has_infection + has_bleeding + has_bone_pain + has_skin >= 3",
        "cardinals_4plus": "has_lymphad + has_bsym + has_infection + has_bleeding + has_bone_pain + has_skin >= 4",
        "persistent_infection": "b_infection >= 2", "persistent_bleeding": "b_bleeding >= 2", "persistent_bsym": "b_bsym >= 2", "persistent_blood_abn": "b_blood_abn >= 2",
        "over50_with_cardinal": "age >= 50 AND has_lymphad + has_bsym + has_infection + has_bleeding + has_bone_pain + has_skin >= 1",
        "over50_2plus": "age >= 50 AND cardinals_2plus = 1", "over60_blood_abn": "age >= 60 AND has_blood_abn = 1",
        "infection_mimic": "has_infection = 1 AND n_antibiotics + n_antibiotic_immuno >= 2", "infection_mimic_recurrent": "has_infection = 1 AND n_antibiotics + n_antibiotic_immuno >= 3",
        "anaemia_mimic": "has_iron = 1 AND has_bleeding = 0", "bleeding_treated": "has_tranexamic = 1 AND has_bleeding = 1", "crp_with_infection": "crp_elevated = 1 AND has_infection = 1",
        "blood_then_haem": "has_blood_abn = 1 AND has_haem_inv = 1", "full_workup": "has_haem_inv = 1 AND has_lymph_proc = 1 AND has_imaging = 1",
        "symptoms_no_investigation": "cardinals_2plus = 1 AND has_haem_inv = 0 AND has_imaging = 0", "antibiotic_acceleration": "b_antibiotics > a_antibiotics",
        "heavy_antibiotic": "b_antibiotics >= 3", "antibiotic_escalation": "has_antibiotics = 1 AND has_antibiotic_immuno = 1",
        "immunocompromise": "has_antifungals = 1 OR has_antibiotic_immuno = 1 OR has_antivirals = 1", "immunocompromise_with_infection": "immunocompromise = 1 AND has_infection = 1",
        "heavy_steroid": "b_steroids >= 3", "steroid_with_bsym": "has_steroids = 1 AND has_bsym = 1", "allopurinol_with_blood_abn": "has_allopurinol = 1 AND has_blood_abn = 1",
        "pruritus_treated": "has_antihistamines = 1 AND has_skin = 1", "peak_age": "age BETWEEN 50 AND 80", "male": "sex = 'M'",
    },
    scores={
        "cardinal_count": "has_lymphad + has_bsym + has_infection + has_bleeding + has_bone_pain + has_skin", "immunoparesis_score": "igg_low + iga_low + igm_low",
        "cytopenia_score": "hb_low + thrombocytopenia + neutropenia", "persistent_count": "persistent_infection + persistent_bleeding + persistent_bsym + persistent_blood_abn",
        "pathway": "least(has_imaging + has_haem_inv + has_lymph_proc, 3)", "suspicion_score": SUSPICION,
    },
    cuts={"suspicion_high": "suspicion_score >= 4", "suspicion_very_high": "suspicion_score >= 6"},
    burden_products=["has_blood_abn", "blasts_present", "suspicion_score"],
    systems={"blood": ["blood_abn"], "bsym": ["bsym"], "consequence": ["bleeding", "infection"], "constitutional": ["bone_pain", "gi"]},
    trends=["blood_abn", "bsym", "infection", "bleeding", "lymphad", "bone_pain", "skin", "imaging", "haem_inv"],
    onsets=["blood_abn", "bsym", "infection", "bleeding", "lymphad", "bone_pain", "skin", "haem_inv", "imaging"],
    sequences=[("blood_abn", "haem_inv", 30), ("blood_abn", "haem_inv", 60), ("lymphad", "lymph_proc", 60), ("lymphad", "imaging", 60), ("bsym", "haem_inv", 90),
               ("infection", "blood_abn", 180), ("bleeding", "blood_abn", 60), ("bone_pain", "haem_inv", 180), ("skin", "lymphad", 180), ("symptom", "haem_inv", 36500)],
    products={
        "blood_blasts": ["has_blood_abn", "blasts_present"], "lymphad_lymphocytosis": ["has_lymphad", "lymphocytosis"], "bsym_blasts": ["has_bsym", "blasts_present"],
        "bleeding_thrombocytopenia": ["has_bleeding", "thrombocytopenia"], "infection_neutropenia": ["has_infection", "neutropenia"], "blood_pancytopenia": ["has_blood_abn", "pancytopenia"],
        "lymphad_immunoparesis": ["has_lymphad", "immunoparesis_2plus"], "blood_ldh": ["has_blood_abn", "ldh_high"], "bleeding_coag": ["has_bleeding", "coagulopathy"], "pathway": ["pathway"],
    },
    weights={
        "BLOOD_COUNT_ABNORMALITIES": 3.0, "B_SYMPTOMS": 2.5, "LYMPHADENOPATHY": 2.5, "BLEEDING_BRUISING": 2.5, "INFECTION": 2.0, "BONE_PAIN": 1.5, "SKIN_LYMPHOPROLIFERATIVE": 1.5,
        "GI_SYMPTOMS": 1.0, "IMAGING": 1.0, "LYMPH_NODE_PROCEDURE": 2.0, "HAEMATOLOGY_INVESTIGATIONS": 1.5, "AUTOIMMUNE_SCREEN": 1.0, "KEY_BLOOD_TESTS": 0.5,
    },
    symptoms=["B_SYMPTOMS", "LYMPHADENOPATHY", "BLEEDING_BRUISING", "INFECTION", "SKIN_LYMPHOPROLIFERATIVE", "BONE_PAIN", "GI_SYMPTOMS"],
    vocabularies={
        "lab": ["KEY_BLOOD_TESTS", "HAEMATOLOGY_INVESTIGATIONS", "AUTOIMMUNE_SCREEN", "BMI", "BODY_WEIGHT", "IDEAL_BODY_WEIGHT", "SYSTOLIC_BP", "DIASTOLIC_BP", "HEART_RATE"],
        "investigation": ["IMAGING", "LYMPH_NODE_PROCEDURE", "HAEMATOLOGY_INVESTIGATIONS", "AUTOIMMUNE_SCREEN"],
        "decay": ["BLOOD_COUNT_ABNORMALITIES", "B_SYMPTOMS", "LYMPHADENOPATHY", "BLEEDING_BRUISING", "INFECTION", "BONE_PAIN", "SKIN_LYMPHOPROLIFERATIVE"],
    },
)
