"""Names, word lists and constants that results must match."""

# Marker used in raw text tables for "not reported".
MISSING_MARKER = "'--"
NOT_REPORTED_LABEL = "Não Reportado"

# Text tokens read as NULL from delimited files.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# Key shared by the clinical and the sample table.
CASE_KEY = "cases.submitter_id"

# Raw column -> working name.
SURVIVAL_COLUMNS = {
    "demographic.vital_status": "vital_status",
    "diagnoses.days_to_last_follow_up": "days_to_last_follow_up",
    "demographic.days_to_death": "days_to_death",
    "demographic.age_at_index": "age_at_index",
    "diagnoses.ajcc_pathologic_stage": "ajcc_pathologic_stage",
    "diagnoses.tissue_or_organ_of_origin": "tissue_or_organ_of_origin",
}

# Columns of the stored survival feature table.
FINAL_FEATURES = [
    "event_occurred",
    "observed_time",
    "age_at_index",
    "ajcc_pathologic_stage",
    "tissue_or_organ_of_origin",
]

NUMERIC_TEXT_COLUMNS = ["days_to_last_follow_up", "days_to_death", "age_at_index"]

DEAD = "Dead"
DAYS_PER_YEAR = 365.25

# Sites kept by the cohort, then the sparse ones taken out again.
COLON_SITES = [
    "Sigmoid colon",
    "Ascending colon",
    "Colon, NOS",
    "Cecum",
    "Transverse colon",
    "Descending colon",
    "Rectosigmoid junction",
    "Hepatic flexure of colon",
    "Splenic flexure of colon",
]
SPARSE_SITES = ["Hepatic flexure of colon", "Splenic flexure of colon"]

# Stage group -> sub-stages it covers.
STAGE_GROUPS = {
    "Stage I": ["Stage I", "Stage IA", "Stage IB"],
    "Stage II": ["Stage II", "Stage IIA", "Stage IIB", "Stage IIC"],
    "Stage III": ["Stage III", "Stage IIIA", "Stage IIIB", "Stage IIIC"],
    "Stage IV": ["Stage IV", "Stage IVA", "Stage IVB", "Stage IVC"],
}

# Edges of the left-closed age bands.
AGE_EDGES = [0, 40, 50, 60, 70, 80, 100]

# Display names.
DISPLAY_COLUMNS = {
    "age_at_index": "idade",
    "ajcc_pathologic_stage": "estagio_patologico_ajcc",
    "tissue_or_organ_of_origin": "tecido_ou_orgao_de_origem",
}
SITE_LABELS = {
    "Sigmoid colon": "Cólon Sigmoide",
    "Ascending colon": "Cólon Ascendente",
    "Colon, NOS": "Cólon (NOS)",
    "Cecum": "Ceco",
    "Transverse colon": "Cólon Transverso",
    "Descending colon": "Cólon Descendente",
    "Rectosigmoid junction": "Junção Retossigmoide",
}
AGE_BAND_LABELS = {
    "age_0_40": "0-40",
    "age_40_50": "40-50",
    "age_50_60": "50-60",
    "age_60_70": "60-70",
    "age_70_80": "70-80",
    "age_80_100": "80-100",
}
VITAL_LABELS = {1: "Falecido", 0: "Vivo"}
STATUS_LABELS = {0: "Vivo / Censurado", 1: "Falecido"}
RISK_LABELS = ["baixo", "médio", "alto"]
RISK_FACTOR_LABEL = "Fator de Risco (Piora)"
PROTECTIVE_LABEL = "Fator Protetor (Melhora)"
OVERFIT_LABELS = ["SIM", "LEVE", "NÃO"]
OVERFIT_GAPS = [0.05, 0.02]
PREVIEW_COLUMNS = {
    "event_occurred": "Evento (Óbito)",
    "observed_time": "Tempo (Anos)",
    "age_at_index": "Idade",
    "age_group": "Faixa Etária",
    "ajcc_pathologic_stage": "Estágio",
    "tissue_or_organ_of_origin": "Localização",
}
FEATURE_PREFIXES = [
    "tissue_or_organ_of_origin_",
    "ajcc_pathologic_stage_",
    "gender_",
    "race_",
    "ethnicity_",
    "age_group_",
]

# Model names and settings.
COX, FOREST, BOOSTED = "CoxPH", "RandomSurvivalForest", "XGBoostSurvival"
SEED = 42
COX_SETTINGS = {"penalizer": 0.1}
FOREST_SETTINGS = {"trees": 200, "max_depth": 10, "min_leaf": 15, "seed": 42}
BOOSTED_SETTINGS = {
    "rounds": 200,
    "max_depth": 10,
    "learning_rate": 0.05,
    "min_child_weight": 1.0,
    "gamma": 0.2,
    "subsample": 0.8,
    "reg_lambda": 0.1,
    "seed": 42,
}
