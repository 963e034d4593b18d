from ..disease import Disease

# --- fixed values -----------------------------------------------------------
CONSTITUTIONAL = ["WEIGHT_LOSS", "FATIGUE", "APPETITE_LOSS", "NIGHT_SWEATS", "ANAEMIA_DX"]

DISEASE = Disease(
    name="bladder",
    groups={
        "haem": ["HAEMATURIA"], "urinelab": ["URINE_LAB_ABNORMALITIES"], "urineinv": ["URINE_INVESTIGATIONS"], "luts": ["LUTS"], "dysuria": ["DYSURIA"],
        "recuti": ["RECURRENT_UTI"], "imaging": ["IMAGING"], "urological": ["UROLOGICAL_CONDITIONS"], "catheter": ["CATHETER_PROCEDURES"],
        "gynae_bleed": ["GYNAECOLOGICAL_BLEEDING"], "constitutional": CONSTITUTIONAL, "smoker_current": ["CURRENT_SMOKER"], "smoker_ex": ["EX_SMOKER"],
        "bph": ["BPH"], "previous_cancer": ["PREVIOUS_CANCER"], "uti_antibiotics": ["UTI_ANTIBIOTICS"], "haemostatic": ["HAEMOSTATIC"],
        "anticoagulants": ["ANTICOAGULANTS"], "catheter_supplies": ["CATHETER_SUPPLIES_CATHETERS"],
    },
    subtypes={
        "haem_frank": ("haem", "frank"), "haem_painless": ("haem", "painless"), "haem_painful": ("haem", "painful"), "haem_microscopic": ("haem", "microscopic"),
        "haem_history": ("haem", "history|h/o"),
        "urine_culture": ("urineinv", "culture"), "urine_microscopy": ("urineinv", "microscopy"), "urine_msu": ("urineinv", "msu|mid-stream"),
        "urine_cytology": ("urineinv", "cytolog"), "urine_antibacterial": ("urineinv", "antibacterial"),
        "urine_blood_test": ("urinelab", "blood test"), "urine_red": ("urinelab", "red cells|red "), "urine_protein": ("urinelab", "protein"),
        "urine_dark": ("urinelab", "dark|concentrated"), "urine_leucocyte": ("urinelab", "leucocyte"), "urine_lab_cytology": ("urinelab", "cytolog"),
        "urine_specific_gravity": ("urinelab", "specific gravity"),
        "luts_bladder_pain": ("luts", "bladder pain"), "luts_difficulty": ("luts", "difficulty"), "luts_hesitancy": ("luts", "delay|hesitancy"),
        "luts_dribbling": ("luts", "dribbling"), "luts_frequency": ("luts", "frequency|polyuria"), "luts_retention": ("luts", "retention"),
        "luts_uti": ("luts", "urinary tract infect"),
    },
    # --- end of fixed values: what follows is combined from them, but for weights, orders and vocabularies ---
    flags={
        "haem_recurrent": "n_haem > 1", "haem_frequent": "n_haem >= 3", "luts_recurrent": "n_luts > 1", "smoking_any": "has_smoker_current = 1 OR has_smoker_ex = 1",
        "smoker_over65": "age >= 65 AND smoking_any = 1", "haem_over65": "age >= 65 AND has_haem = 1", "haem_x_urineinv": "has_haem = 1 AND has_urineinv = 1",
        "haem_x_urinelab": "has_haem = 1 AND has_urinelab = 1", "haem_x_smoking": "has_haem = 1 AND smoking_any = 1", "recuti_x_haem": "has_recuti = 1 AND has_haem = 1",
        "elderly_smoker": "age >= 70 AND smoking_any = 1",
    },
    scores={
        "risk_score": "has_previous_cancer * 3 + has_recuti * 2 + has_bph + has_smoker_current * 3 + has_smoker_ex", "urine_activity": "n_urineinv + n_urinelab",
        "haem_acceleration": "if(a_haem > 0, b_haem / a_haem, if(b_haem > 0, 2, 0))", "urinelab_acceleration": "if(a_urinelab > 0, b_urinelab / a_urinelab, if(b_urinelab > 0, 2, 0))",
        "pathway": "least(has_imaging + has_urological, 2)",
    },
    systems={"constitutional": ["constitutional"], "urinary": ["luts", "dysuria", "recuti"], "bleeding": ["haem", "gynae_bleed"]},
    trends=["haem", "luts", "dysuria", "urinelab", "urineinv", "recuti", "imaging", "urological", "constitutional"],
    onsets=["haem", "luts", "dysuria", "recuti", "urinelab", "urineinv", "imaging", "urological", "constitutional"],
    sequences=[("haem", "imaging", 60), ("haem", "urological", 90), ("haem", "urineinv", 60), ("luts", "haem", 90), ("luts", "imaging", 180),
               ("recuti", "haem", 180), ("recuti", "imaging", 180), ("urinelab", "imaging", 60)],
    products={
        "haemB_smoking": ["b_haem", "smoking_any"], "haemB_smoking_current": ["b_haem", "has_smoker_current"], "haemB_recuti": ["b_haem", "has_recuti"],
        "lutsB_haem": ["b_luts", "has_haem"], "haemB_urinelab": ["b_haem", "b_urinelab"], "haemB_imaging": ["b_haem", "b_imaging"], "recutiB_haem": ["b_recuti", "has_haem"],
        "uti_antibiotics": ["has_uti_antibiotics"], "haemostatic": ["has_haemostatic"], "anticoagulants": ["has_anticoagulants"], "catheter_supplies": ["has_catheter_supplies"],
        "pathway": ["pathway"],
    },
    weights={
        "HAEMATURIA": 3.0, "URINE_LAB_ABNORMALITIES": 2.0, "URINE_INVESTIGATIONS": 1.0, "RECURRENT_UTI": 2.0, "BPH": 0.5, "LUTS": 1.0, "DYSURIA": 1.0,
        "SUPRAPUBIC_PAIN": 1.5, "BACK_PAIN": 0.5, "LOIN_PAIN": 1.0, "IMAGING": 1.5, "UROLOGICAL_CONDITIONS": 2.0, "CATHETER_PROCEDURES": 1.5,
        "GYNAECOLOGICAL_BLEEDING": 1.0, "WEIGHT_LOSS": 2.0, "FATIGUE": 1.0, "APPETITE_LOSS": 1.5, "NIGHT_SWEATS": 1.0, "ANAEMIA_DX": 2.0,
        "PREVIOUS_CANCER": 2.0, "CURRENT_SMOKER": 2.0, "EX_SMOKER": 1.0, "DVT": 1.0, "PULMONARY_EMBOLISM": 1.0, "FRAILTY": 1.0,
    },
    symptoms=["HAEMATURIA", "LUTS", "DYSURIA", "SUPRAPUBIC_PAIN", "BACK_PAIN", "LOIN_PAIN", "WEIGHT_LOSS", "FATIGUE", "APPETITE_LOSS", "NIGHT_SWEATS", "ANAEMIA_DX",
              "GYNAECOLOGICAL_BLEEDING"],
    vocabularies={
        "lab": ["RENAL", "HAEMATOLOGY", "INFLAMMATORY", "LIVER", "METABOLIC", "ELECTROLYTES", "PSA", "BMI", "BODY_WEIGHT", "IDEAL_BODY_WEIGHT", "SYSTOLIC_BP", "DIASTOLIC_BP", "HEART_RATE"],
        "investigation": ["IMAGING", "URINE_INVESTIGATIONS", "URINE_LAB_ABNORMALITIES"],
        "decay": ["HAEMATURIA", "URINE_LAB_ABNORMALITIES", "LUTS", "DYSURIA", "WEIGHT_LOSS", "FATIGUE", "ANAEMIA_DX", "RECURRENT_UTI", "LOIN_PAIN", "SUPRAPUBIC_PAIN"],
    },
)
