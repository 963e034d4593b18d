from ..disease import Disease

# --- fixed values -----------------------------------------------------------
SUSPICION = ("4 * has_personal_hx + 3 * has_excision + 2 * has_histology + 2 * has_pcl + has_dermoscopy + has_referral + has_lesion + has_mole"
             " + has_biopsy + has_prior_bcc_scc + has_immunosuppressants + has_actinic_tx")

DISEASE = Disease(
    name="melanoma",
    groups={
        "pcl": ["NICE_7PCL_FEATURES"], "referral": ["DERMATOLOGY_REFERRAL_CLINIC"], "dermoscopy": ["DERMATOSCOPY_PHOTOGRAPHY"], "lesion": ["SKIN_LESION_PRESENTATION"],
        "mole": ["MOLE_NAEVUS_PIGMENTED_LESION"], "signs": ["CLINICAL_SIGNS"], "histology": ["HISTOLOGY"], "biopsy": ["PRIOR_SKIN_PROCEDURES_BIOPSY"], "excision": ["WIDE_EXCISION_GRAFTING"],
        "plastic": ["PLASTIC_SURGERY"], "cryo": ["CRYOTHERAPY"], "other_lesions": ["OTHER_SKIN_LESIONS"], "insect": ["INSECT_BITES"], "skin_infection": ["SKIN_INFECTION_WORKUP"],
        "virology": ["VIROLOGY_SKIN_RELATED"], "skin_symptoms": ["SKIN_SYMPTOMS"], "sun_damage": ["SUN_DAMAGE_PRE_MALIGNANT"], "prior_bcc_scc": ["PRIOR_SKIN_CANCER_BCC_SCC"],
        "family_hx": ["FAMILY_HISTORY"], "personal_hx": ["PERSONAL_HISTORY"], "risk_factor": ["RISK_FACTOR"],
        "procedure": ["WIDE_EXCISION_GRAFTING", "CRYOTHERAPY", "PRIOR_SKIN_PROCEDURES_BIOPSY", "HISTOLOGY", "PLASTIC_SURGERY", "MINOR_SURGERY_ADMIN", "SUTURE_POST_OP_MINOR_SURGERY"],
        "immunosuppressants": ["IMMUNOSUPPRESSANT_SYSTEMIC", "IMMUNOSUPPRESSANT_CORTICOSTEROIDS"], "actinic_tx": ["ACTINIC_PRE_MALIGNANT_TREATMENT"],
        "topical": ["TOPICAL_STEROIDS_SKIN", "TOPICAL_ANTIBIOTICS_SKIN", "TOPICAL_SKIN_OTHER", "TOPICAL_STEROID_SCALP"],
        "surgical_med": ["LOCAL_ANAESTHETICS_SKIN", "SUTURES_WOUND_TAPE", "WOUND_DRESSINGS", "WOUND_CARE"],
    },
    # --- end of fixed values: what follows is combined from them, but for weights, orders and vocabularies ---
    flags={
        "pathway_complete": "has_lesion = 1 AND has_dermoscopy = 1 AND has_histology = 1", "pathway_with_excision": "pathway_complete = 1 AND has_excision = 1",
        "excision_with_histology": "has_excision = 1 AND has_histology = 1", "excision_with_plastic": "has_excision = 1 AND has_plastic = 1",
        "keratosis_mimic": "has_other_lesions = 1 AND has_cryo = 1 AND has_histology = 0", "insect_mimic": "has_insect = 1 AND has_dermoscopy = 0 AND has_histology = 0",
        "infection_mimic": "(has_skin_infection = 1 OR has_virology = 1) AND has_histology = 0",
        "symptoms_no_investigation": "has_pcl + has_referral + has_dermoscopy + has_lesion + has_mole + has_signs >= 2 AND has_dermoscopy = 0 AND has_histology = 0 AND has_biopsy = 0",
        "over50_with_lesion": "age >= 50 AND has_lesion = 1",
        "over50_2plus": "age >= 50 AND has_pcl + has_referral + has_dermoscopy + has_lesion + has_mole + has_signs >= 2",
        "persistent_lesion": "b_lesion >= 2", "persistent_mole": "b_mole >= 2", "persistent_pcl": "b_pcl >= 2",
    },
    scores={
        "cardinal_count": "has_pcl + has_referral + has_dermoscopy + has_lesion + has_mole + has_signs",
        "risk_factor_count": "has_sun_damage + has_prior_bcc_scc + has_family_hx + has_personal_hx + has_immunosuppressants + has_risk_factor",
        "pathway": "least(has_dermoscopy + has_histology + has_referral, 3)", "suspicion_score": SUSPICION,
    },
    cuts={"suspicion_high": "suspicion_score >= 5", "suspicion_very_high": "suspicion_score >= 8"},
    burden_products=["suspicion_score"],
    systems={"lesion": ["lesion", "mole", "pcl"], "workup": ["dermoscopy", "referral", "biopsy", "histology"], "treatment": ["excision", "plastic", "cryo"]},
    trends=["lesion", "mole", "pcl", "dermoscopy", "referral", "biopsy", "histology", "excision"],
    onsets=["lesion", "mole", "pcl", "dermoscopy", "referral", "biopsy", "histology", "excision", "personal_hx", "sun_damage"],
    sequences=[("lesion", "dermoscopy", 60), ("lesion", "referral", 60), ("lesion", "biopsy", 90), ("lesion", "histology", 90), ("lesion", "excision", 180), ("mole", "dermoscopy", 60),
               ("pcl", "excision", 90), ("pcl", "referral", 30), ("dermoscopy", "excision", 60), ("biopsy", "histology", 30), ("excision", "plastic", 60), ("personal_hx", "lesion", 180)],
    products={
        "lesion_excision": ["has_lesion", "has_excision"], "lesion_histology": ["has_lesion", "has_histology"], "pcl_referral": ["has_pcl", "has_referral"], "pcl_excision": ["has_pcl", "has_excision"],
        "mole_dermoscopy": ["has_mole", "has_dermoscopy"], "personal_lesion": ["has_personal_hx", "has_lesion"], "prior_bcc_lesion": ["has_prior_bcc_scc", "has_lesion"],
        "immuno_lesion": ["has_immunosuppressants", "has_lesion"], "lesionB_excisionB": ["b_lesion", "b_excision"], "personal_excision": ["has_personal_hx", "has_excision"], "pathway": ["pathway"],
    },
    weights={
        "PERSONAL_HISTORY": 4.0, "WIDE_EXCISION_GRAFTING": 3.0, "HISTOLOGY": 2.5, "NICE_7PCL_FEATURES": 2.5, "PRIOR_SKIN_CANCER_BCC_SCC": 2.0, "MOLE_NAEVUS_PIGMENTED_LESION": 1.5,
        "SKIN_LESION_PRESENTATION": 1.5, "DERMATOSCOPY_PHOTOGRAPHY": 1.5, "PRIOR_SKIN_PROCEDURES_BIOPSY": 2.0, "DERMATOLOGY_REFERRAL_CLINIC": 1.5, "PLASTIC_SURGERY": 2.0, "CRYOTHERAPY": 1.0,
        "SUN_DAMAGE_PRE_MALIGNANT": 1.5, "FAMILY_HISTORY": 1.5, "RISK_FACTOR": 1.0, "CLINICAL_SIGNS": 1.0, "OTHER_SKIN_LESIONS": 0.5, "SKIN_SYMPTOMS": 0.5, "SKIN_TREATMENT_WOUND": 0.5,
        "SUTURE_POST_OP_MINOR_SURGERY": 1.0, "MINOR_SURGERY_ADMIN": 0.5,
    },
    symptoms=["MOLE_NAEVUS_PIGMENTED_LESION", "NICE_7PCL_FEATURES", "SKIN_LESION_PRESENTATION", "SKIN_SYMPTOMS", "CLINICAL_SIGNS"],
    vocabularies={"lab": ["BMI", "BODY_WEIGHT", "IDEAL_BODY_WEIGHT", "SYSTOLIC_BP", "DIASTOLIC_BP", "HEART_RATE"],
                  "investigation": ["DERMATOSCOPY_PHOTOGRAPHY", "HISTOLOGY", "PRIOR_SKIN_PROCEDURES_BIOPSY"],
                  "decay": ["MOLE_NAEVUS_PIGMENTED_LESION", "NICE_7PCL_FEATURES", "SKIN_LESION_PRESENTATION", "SKIN_SYMPTOMS", "CLINICAL_SIGNS", "DERMATOLOGY_REFERRAL_CLINIC"]},
)
