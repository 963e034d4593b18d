from ..disease import Disease

# --- fixed values -----------------------------------------------------------
DISEASE = Disease(
    name="prostate",
    groups={
        "luts": ["LUTS"], "haem": ["HAEMATURIA"], "retention": ["URINARY_RETENTION"], "erectile": ["ERECTILE_DYSFUNCTION"], "pain": ["PAIN_PELVIC_BONE"],
        "bone_muscle": ["BONE_MUSCLE"], "bone": ["PAIN_PELVIC_BONE", "BONE_MUSCLE"], "constitutional": ["CONSTITUTIONAL"], "psa": ["PSA"], "dre": ["DRE"],
        "imaging": ["UROLOGY_IMAGING"], "cystoscopy": ["CYSTOSCOPY"], "pathway": ["UROLOGY_PATHWAY"], "ipss": ["IPSS"], "prostatic": ["PROSTATIC_CONDITIONS"],
        "family_history": ["FAMILY_HISTORY"], "smoking": ["SMOKING"], "urinary": ["LUTS", "HAEMATURIA", "URINARY_RETENTION"],
        "investigation": ["UROLOGY_IMAGING", "CYSTOSCOPY", "DRE"], "alpha_blockers": ["ALPHA_BLOCKERS"], "reductase": ["5ARI"], "uti_antibiotics": ["UTI_ANTIBIOTICS"],
        "pain_meds": ["PAIN_ESCALATION"], "anticholinergics": ["ANTICHOLINERGICS"], "catheter_supplies": ["CATHETER_SUPPLIES"], "ed_meds": ["ED_MEDICATIONS"],
    },
    subtypes={
        "frank_haematuria": ("haem", r"frank\s+haematuria|macroscopic\s+haematuria|visible\s+haematuria"),
        "microscopic_haematuria": ("haem", r"microscopic\s+haematuria|non[\s-]*visible\s+haematuria"),
        "dre_abnormal": ("dre", r"abnormal|hard|nodul|irregular|suspicious"),
        "raised_psa": ("psa", r"rais(e|ed)\s+psa|psa\s+raised|elevated\s+psa|psa\s+elevated"),
        "psa_abnormal": ("psa", r"abnormal.*psa|psa.*abnormal|serum\s+psa.*abnormal"),
        "retention_code": ("retention", r"retention\s+of\s+urine|urinary\s+retention"),
        "current_smoker": ("smoking", r"current\s+smoker|smokes|daily\s+smok"),
        "former_smoker": ("smoking", r"ex[\s-]*smoker|former\s+smoker|stopped\s+smoking|smoking\s+cessation"),
        "never_smoker": ("smoking", r"never\s+smok|non[\s-]*smoker|lifetime\s+non[\s-]*smoker"),
        "famhx_prostate": ("family_history", r"family\s+history.*prostat|prostat.*family\s+history"),
        "famhx_any_cancer": ("family_history", r"family\s+history.*(cancer|malignan|neoplasm|carcinoma)"),
        "famhx_male_genital": ("family_history", r"family\s+history.*(male\s+genital|testic|penile)"),
    },
    labs={
        "psa_value": (["PSA"], "prostate specific antigen|Serum PSA"), "alp": (["ALP_BONE_MARKER"], "alkaline phosphatase"), "crp": (["HAEMATOLOGY"], "C reactive protein"),
        "hb": (["FBC_HAEMATOLOGY"], "haemoglobin|hemoglobin"), "testosterone": (["HORMONAL"], "testosterone"), "calcium": (["CALCIUM"], "calcium"), "ipss_value": (["IPSS"], "."),
    },
    lab_flags={
        "psa_elevated_4": "psa_value_latest > 4", "psa_elevated_10": "psa_value_latest > 10", "psa_elevated_20": "psa_value_latest > 20", "psa_very_high": "psa_value_latest > 100",
        "psa_rising": "psa_value_latest - psa_value_first > 0", "psa_rapid_rise": "psa_value_latest - psa_value_first > 2",
        "psa_age_adjusted_high": "(age < 60 AND psa_value_latest > 3) OR (age >= 60 AND age < 70 AND psa_value_latest > 4) OR (age >= 70 AND psa_value_latest > 5)",
        "alp_elevated": "alp_latest > 130", "crp_elevated": "crp_latest > 10", "hb_low": "hb_latest < 120", "testosterone_low": "testosterone_latest < 8",
        "calcium_high": "calcium_latest > 2.6", "calcium_very_high": "calcium_latest > 2.85", "ipss_severe": "ipss_value_latest >= 20",
        "ipss_moderate": "ipss_value_latest >= 8 AND ipss_value_latest < 20", "ipss_mild": "ipss_value_latest >= 1 AND ipss_value_latest < 8",
        "psa_alp_both_high": "psa_value_max > 4 AND alp_max > 130", "psa_alp_both_very_high": "psa_value_max > 10 AND alp_max > 200",
        "psa_high_anaemia": "psa_value_max > 4 AND hb_min BETWEEN 1 AND 130",
    },
    # --- end of fixed values: what follows is combined from them, but for weights, orders and vocabularies ---
    flags={
        "bph_combination": "has_alpha_blockers = 1 AND has_reductase = 1", "peak_age": "age BETWEEN 50 AND 80", "over65_psa": "age >= 65 AND psa_elevated_4 = 1",
        "over65_luts": "age >= 65 AND has_luts = 1", "psa_plus_bone": "psa_elevated_4 = 1 AND has_bone = 1", "bone_trio": "alp_elevated + calcium_high + hb_low >= 3",
        "bone_pair": "alp_elevated + calcium_high + hb_low >= 2", "family_relevant": "famhx_prostate_flag + famhx_male_genital_flag > 0",
    },
    scores={
        "risk_score": "CAST(age >= 65 AS INT) + psa_elevated_10 + has_luts + has_bone + has_imaging", "family_score": "famhx_prostate_flag * 2 + famhx_male_genital_flag + famhx_any_cancer_flag",
        "bone_score": "alp_elevated + calcium_high + hb_low",
    },
    systems={"constitutional": ["constitutional"], "urinary": ["urinary"], "bone": ["bone"]},
    trends=["luts", "haem", "bone", "constitutional", "retention"],
    onsets=["luts", "haem", "pain", "bone_muscle", "constitutional", "retention", "psa", "imaging", "dre"],
    sequences=[("luts", "haem", 90), ("luts", "imaging", 180), ("luts", "retention", 180), ("haem", "imaging", 60), ("pain", "constitutional", 90),
               ("bone_muscle", "constitutional", 90), ("psa", "imaging", 60), ("psa", "dre", 60), ("urinary", "investigation", 36500)],
    products={
        "lutsB_raised_psa": ["b_luts", "raised_psa_flag"], "haemB_raised_psa": ["b_haem", "raised_psa_flag"], "boneB_raised_psa": ["b_bone", "raised_psa_flag"],
        "lutsB_psa_max": ["b_luts", "psa_value_max"], "boneB_alp": ["b_bone", "alp_elevated"], "alp": ["alp_elevated"], "hb_low": ["hb_low"], "crp": ["crp_elevated"],
        "psa_max": ["psa_value_max"], "family_score": ["family_score"], "pathway": ["has_pathway"], "pain_meds_B": ["b_pain_meds"], "uti_antibiotics_B": ["b_uti_antibiotics"],
    },
    weights={
        "BONE_MUSCLE": 1.0, "PAIN_PELVIC_BONE": 1.0, "CONSTITUTIONAL": 2.0, "URINARY_RETENTION": 2.0, "HAEMATURIA": 2.0, "LUTS": 1.0, "ERECTILE_DYSFUNCTION": 0.5,
        "CATHETER": 1.5, "PROSTATIC_CONDITIONS": 1.0, "FAMILY_HISTORY": 1.5, "CYSTOSCOPY": 2.0, "UROLOGY_IMAGING": 1.5, "UROLOGY_PATHWAY": 1.5, "DRE": 1.0, "IPSS": 0.5,
    },
    symptoms=["LUTS", "URINARY_RETENTION", "HAEMATURIA", "UTI", "PAIN_PELVIC_BONE", "BONE_MUSCLE", "CONSTITUTIONAL", "ERECTILE_DYSFUNCTION", "PROSTATIC_CONDITIONS", "CATHETER", "WEIGHT"],
    vocabularies={
        "investigation": ["UROLOGY_IMAGING", "CYSTOSCOPY", "DRE", "SCREENING_PATHWAY"], "decay": ["LUTS", "HAEMATURIA", "PAIN_PELVIC_BONE", "PSA", "URINARY_RETENTION", "CONSTITUTIONAL"],
        "lab": ["PSA", "PSA_FREE", "PSA_RATIO", "RENAL_FUNCTION", "ELECTROLYTES", "HAEMATOLOGY", "FBC_HAEMATOLOGY", "ALP_BONE_MARKER", "ALBUMIN_PROTEIN", "LIVER_FUNCTION", "CALCIUM",
                "COAGULATION", "HORMONAL", "INFLAMMATORY", "URINE_MARKERS", "VITAMIN_D", "BMI", "BODY_WEIGHT", "IDEAL_BODY_WEIGHT", "SYSTOLIC_BP", "DIASTOLIC_BP", "HEART_RATE"],
    },
)
