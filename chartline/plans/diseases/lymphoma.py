from ..disease import Disease

# --- fixed values -----------------------------------------------------------
LAB = ["LAB_MARKERS"]

DISEASE = Disease(
    name="lymphoma",
    groups={
        "lymphad": ["LYMPHADENOPATHY"], "spleno": ["SPLENOMEGALY"], "masses": ["UNEXPLAINED_MASSES"], "nodal": ["LYMPHADENOPATHY", "UNEXPLAINED_MASSES", "SPLENOMEGALY"],
        "bsym": ["B_SYMPTOMS"], "constitutional": ["CONSTITUTIONAL_SYMPTOMS"], "haem_abn": ["HAEMATOLOGICAL_ABNORMALITIES"], "infection_markers": ["INFECTION_MARKERS"],
        "recurrent_inf": ["RECURRENT_INFECTIONS"], "autoimmune": ["AUTOIMMUNE_IMMUNE"], "skin": ["SKIN_SYMPTOMS"], "imaging": ["ABNORMAL_IMAGING"], "lab": LAB,
        "antibiotics": ["ANTIBIOTICS"], "antifungals": ["ANTIFUNGALS"], "antivirals": ["ANTIVIRALS"], "steroids": ["CORTICOSTEROIDS"], "anaemia_tx": ["ANAEMIA_TREATMENT"],
        "nutrition": ["NUTRITIONAL_SUPPLEMENTS"], "antihistamines": ["PAIN_ANTIHISTAMINES"],
    },
    labs={
        "ldh": (LAB, r"lactate\s+dehydrogenase|^LDH\b"), "b2m": (LAB, r"beta[\s-]*2[\s-]*microglobulin"), "crp": (LAB, r"C[\s-]*reactive\s+protein|CRP"),
        "esr": (LAB, r"Erythrocyte\s+sedimentation|^ESR\b"), "calcium": (LAB, r"(?:adjusted\s+)?calcium"), "bilirubin": (LAB, "bilirubin"), "gfr": (LAB, r"eGFR|glomerular\s+filtration"),
        "vitd": (LAB, r"vitamin\s*D|25[\s-]*OH"), "igm": (LAB, r"Immunoglobulin\s*M\b|^IgM\b"), "iga": (LAB, r"Immunoglobulin\s*A\b|^IgA\b"), "igg": (LAB, r"Immunoglobulin\s*G\b|^IgG\b"),
        "kl_ratio": (LAB, r"Kappa.*lambda|kappa[/_\s]*lambda|light\s+chain\s+ratio|free\s+light\s+chain\s+ratio"), "paraprotein": (LAB, "paraprotein"), "immunofixation": (LAB, "immunofixation"),
    },
    lab_flags={
        "ldh_elevated": "ldh_latest > 250", "ldh_very_high": "ldh_latest > 500", "ldh_rising": "ldh_latest - ldh_first > 0", "ldh_rapid_rise": "ldh_latest - ldh_first > 100",
        "b2m_elevated": "b2m_latest > 2.5", "crp_elevated": "crp_latest > 10", "crp_high": "crp_max > 30", "esr_elevated": "esr_latest > 30", "calcium_high": "calcium_latest > 2.6",
        "bilirubin_elevated": "bilirubin_latest > 21", "gfr_low": "gfr_latest < 60", "vitd_low": "vitd_latest < 30", "igm_elevated": "igm_latest > 3", "igm_very_high": "igm_latest > 10",
        "iga_elevated": "iga_latest > 4", "igg_elevated": "igg_latest > 16", "igg_low": "igg_latest < 6", "iga_low": "iga_latest < 0.7", "igm_low": "igm_latest < 0.4",
        "kl_ratio_abnormal": "kl_ratio_latest < 0.26 OR kl_ratio_latest > 1.65", "kl_ratio_extreme": "kl_ratio_latest < 0.1 OR kl_ratio_latest > 8",
    },
    # --- end of fixed values: what follows is combined from them, but for weights, orders and vocabularies ---
    flags={
        "nodal_acceleration": "b_nodal > a_nodal", "nodal_triad": "has_lymphad = 1 AND has_spleno = 1 AND has_masses = 1", "nodal_pair": "has_lymphad + has_spleno + has_masses >= 2",
        "bsym_acceleration": "b_bsym > a_bsym", "bsym_persistent": "b_bsym >= 2", "bsym_or_constitutional": "has_bsym = 1 OR has_constitutional = 1",
        "bsym_with_lymphad": "has_bsym = 1 AND has_lymphad = 1", "bsym_with_spleno": "has_bsym = 1 AND has_spleno = 1", "immunoparesis_2plus": "igg_low + iga_low + igm_low >= 2",
        "ipi_pair": "ldh_elevated = 1 AND b2m_elevated = 1", "haem_abn_acceleration": "b_haem_abn > a_haem_abn", "antibiotic_acceleration": "b_antibiotics > a_antibiotics",
        "heavy_antibiotic": "b_antibiotics >= 3", "atypical_antimicrobial": "b_antifungals + b_antivirals > 0", "recurrent_inf_heavy_antibiotic": "has_recurrent_inf = 1 AND heavy_antibiotic = 1",
        "recurrent_inf_immunoparesis": "has_recurrent_inf = 1 AND immunoparesis_2plus = 1", "steroid_acceleration": "b_steroids > a_steroids", "heavy_steroid": "b_steroids >= 3",
        "pruritus_with_antihistamine": "has_skin = 1 AND has_antihistamines = 1", "pruritus_with_bsym": "has_skin = 1 AND has_bsym = 1",
    },
    scores={"immunoparesis_score": "igg_low + iga_low + igm_low", "antimicrobials_B": "b_antibiotics + b_antifungals + b_antivirals", "pathway": "least(has_imaging + has_lab, 2)",
            "ipi_score": "CASE WHEN age >= 60 THEN 1 ELSE 0 END + ldh_elevated + has_bsym + has_lymphad + has_spleno"},
    cuts={"ipi_high": "ipi_score >= 3", "ipi_very_high": "ipi_score >= 4"},
    burden_products=["ipi_score"],
    systems={"nodal": ["nodal"], "bsym": ["bsym"], "haem": ["haem_abn"], "constitutional": ["constitutional"]},
    trends=["lymphad", "spleno", "masses", "bsym", "constitutional", "skin", "imaging", "haem_abn", "recurrent_inf", "nodal"],
    onsets=["lymphad", "spleno", "masses", "bsym", "constitutional", "haem_abn", "skin", "recurrent_inf", "imaging", "infection_markers"],
    sequences=[("lymphad", "imaging", 60), ("lymphad", "lab", 30), ("bsym", "imaging", 90), ("bsym", "lab", 60), ("masses", "imaging", 30), ("spleno", "imaging", 30),
               ("haem_abn", "lab", 60), ("recurrent_inf", "lymphad", 180), ("skin", "lymphad", 180)],
    products={
        "lymphad_ldh": ["has_lymphad", "ldh_elevated"], "bsym_ldh": ["has_bsym", "ldh_elevated"], "lymphad_bsym": ["has_lymphad", "has_bsym"], "lymphadB_ldh": ["b_lymphad", "ldh_elevated"],
        "bsymB_ldh": ["b_bsym", "ldh_elevated"], "lymphad_b2m": ["has_lymphad", "b2m_elevated"], "spleno_ldh": ["has_spleno", "ldh_elevated"],
        "bsym_immunoparesis": ["has_bsym", "immunoparesis_2plus"], "lymphad_paraprotein": ["has_lymphad", "paraprotein_tested"], "pathway": ["pathway"],
    },
    weights={
        "LYMPHADENOPATHY": 3.0, "SPLENOMEGALY": 2.5, "UNEXPLAINED_MASSES": 2.5, "B_SYMPTOMS": 3.0, "CONSTITUTIONAL_SYMPTOMS": 1.5, "HAEMATOLOGICAL_ABNORMALITIES": 2.0,
        "INFECTION_MARKERS": 1.5, "RECURRENT_INFECTIONS": 2.0, "AUTOIMMUNE_IMMUNE": 1.5, "SKIN_SYMPTOMS": 1.5, "ABNORMAL_IMAGING": 1.5, "LAB_MARKERS": 1.0, "PAIN_SYMPTOMS": 1.0,
        "HIGH_RISK_CONDITIONS": 1.0, "RISK_SCORES": 0.5,
    },
    symptoms=["B_SYMPTOMS", "LYMPHADENOPATHY", "SPLENOMEGALY", "SKIN_SYMPTOMS", "CONSTITUTIONAL_SYMPTOMS", "UNEXPLAINED_MASSES", "PAIN_SYMPTOMS"],
    vocabularies={
        "lab": ["LAB_MARKERS", "BMI", "BODY_WEIGHT", "IDEAL_BODY_WEIGHT", "SYSTOLIC_BP", "DIASTOLIC_BP", "HEART_RATE"], "investigation": ["ABNORMAL_IMAGING", "LAB_MARKERS", "INFECTION_MARKERS"],
        "decay": ["B_SYMPTOMS", "LYMPHADENOPATHY", "SPLENOMEGALY", "HAEMATOLOGICAL_ABNORMALITIES", "RECURRENT_INFECTIONS", "UNEXPLAINED_MASSES", "ABNORMAL_IMAGING", "SKIN_SYMPTOMS"],
    },
)
