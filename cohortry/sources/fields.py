"""The prespecified fields: names, labels, years and how each is built."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Column name -> label, in column order. The text of a row follows this order.
FIELD_LABELS = {
    "Age": "Age in years at surgery (top-coded, '90+')",
    "ASACLAS": "ASA physical status classification",
    "ASCITES": "Ascites within 30 days before surgery",
    "BLEEDDIS": "Bleeding disorder",
    "CPT": "CPT code of the principal procedure",
    "DIABETES": "Diabetes mellitus status/treatment",
    "DIALYSIS": "Currently on dialysis preoperatively",
    "DISCANCR": "Disseminated cancer",
    "DPRALBUM": "Days before surgery the preoperative serum albumin was drawn",
    "DPRALKPH": "Days before surgery the preoperative alkaline phosphatase was drawn",
    "DPRBILI": "Days before surgery the preoperative total bilirubin was drawn",
    "DPRBUN": "Days before surgery the preoperative blood urea nitrogen was drawn",
    "DPRCREAT": "Days before surgery the preoperative serum creatinine was drawn",
    "DPRHCT": "Days before surgery the preoperative haematocrit was drawn",
    "DPRINR": "Days before surgery the preoperative INR was drawn",
    "DPRNA": "Days before surgery the preoperative serum sodium was drawn",
    "DPRPLATE": "Days before surgery the preoperative platelet count was drawn",
    "DPRPTT": "Days before surgery the preoperative partial thromboplastin time was drawn",
    "DPRSGOT": "Days before surgery the preoperative AST/SGOT was drawn",
    "DPRWBC": "Days before surgery the preoperative white blood cell count was drawn",
    "ETHNICITY_HISPANIC": "Hispanic/Latino ethnicity",
    "FNSTATUS2": "Functional health status prior to surgery",
    "HEIGHT": "Height, inches",
    "HtoODay": "Days from hospital admission to operation",
    "HXCHF": "Congestive heart failure within 30 days before surgery",
    "HXCOPD": "History of severe COPD",
    "HYPERMED": "Hypertension requiring medication",
    "INOUT": "Inpatient vs outpatient case designation",
    "PRALBUM": "Preoperative serum albumin",
    "PRALKPH": "Preoperative alkaline phosphatase",
    "PRBILI": "Preoperative total bilirubin",
    "PRBUN": "Preoperative blood urea nitrogen",
    "PRCREAT": "Preoperative serum creatinine",
    "PRHCT": "Preoperative haematocrit",
    "PRINR": "Preoperative INR",
    "PRNCPTX": "Free-text description of the principal procedure",
    "PRPLATE": "Preoperative platelet count",
    "PRPTT": "Preoperative partial thromboplastin time",
    "PRSEPIS": "Preoperative SIRS / sepsis / septic shock status",
    "PRSGOT": "Preoperative AST/SGOT",
    "PRSODM": "Preoperative serum sodium",
    "PRWBC": "Preoperative white blood cell count",
    "RACE_NEW": "Patient race (multi-race as comma-separated combination)",
    "SEX": "Patient sex",
    "SMOKE": "Current smoker within 1 year of surgery",
    "STEROID": "Chronic steroid / immunosuppressant use",
    "SURGSPEC": "Surgical specialty of the operating surgeon",
    "TRANSFUS": (
        ">=1 unit of packed red blood cells or whole blood transfused in the 72 hours "
        "before surgery"),
    "TRANST": "Origin/transfer status at admission",
    "VENTILAT": "Ventilator dependent at time of surgery",
    "WEIGHT": "Weight, pounds",
    "WORKRVU": "Work RVU of the principal procedure",
    "CASETYPE": "Case acuity: elective, urgent, or emergent",
    "DPRHEMOGLOBIN": "Days before surgery the preoperative haemoglobin was drawn",
    "DPRHEMO_A1C": "Days before surgery the preoperative haemoglobin A1c was drawn",
    "DPRPT": "Days before surgery the preoperative prothrombin time was drawn",
    "DYSPNEA": "Dyspnea before surgery: none, on moderate exertion, or at rest",
    "ELECTSURG": "Elective surgery: the procedure was neither emergent nor urgent",
    "EMERGNCY": "Emergency case, as determined by the surgeon or anaesthesiologist",
    "HEMO": "Preoperative haemoglobin A1c, percent, in the earlier PUF coding era",
    "HOMESUP": "For patients 75 or older admitted from home, whether the patient lives alone",
    "HXDEMENTIA": "History of dementia or cognitive impairment",
    "HXFALL": "Fall within the 6 months before surgery",
    "IMMUNO_CAT": "Class or classes of immunosuppressive therapy taken before surgery",
    "OXYGEN_SUPPORT": "Requires supplemental oxygen before surgery",
    "PREOP_COVID": "Preoperative COVID-19 diagnosis, lab-confirmed or suspected",
    "PREOP_CREAT_MSINCR": (
        "Severity of preoperative acute kidney injury, by KDIGO serum-creatinine increase"),
    "PRHEMOGLOBIN": "Preoperative haemoglobin, g/dL",
    "PRHEMO_A1C": "Preoperative haemoglobin A1c, percent, in the later PUF coding era",
    "PRPT": "Preoperative prothrombin time, seconds",
    "RENAFAIL": "Preoperative acute renal failure (2018-2020) or acute kidney injury (2022+)",
    "WNDINF": "Open wound at the time of surgery, with or without infection",
    "WTLOSS": "Malnourishment or unintentional weight loss before surgery",
}

# The fields that not every year has, in column order, with the years that have
# them and how the other years are built.
ALL_YEARS = (2018, 2019, 2020, 2021, 2022, 2023, 2024)
PARTIAL = {
    "Age": ((2018, 2020, 2021, 2022, 2023, 2024), "read directly"),
    "HtoODay": ((2018, 2020, 2021, 2022, 2023, 2024), "read directly"),
    "CASETYPE": ((2021, 2022, 2023, 2024), "missing years approximated by rule"),
    "DPRHEMOGLOBIN": ((2023, 2024), "missing years left as NaN"),
    "DPRHEMO_A1C": ((2023, 2024), "missing years left as NaN"),
    "DPRPT": ((2018, 2019, 2020), "missing years left as NaN"),
    "DYSPNEA": ((2018, 2019, 2020), "missing years left as NaN"),
    "ELECTSURG": ((2018, 2019, 2020), "missing years approximated by rule"),
    "EMERGNCY": ((2018, 2019, 2020), "missing years approximated by rule"),
    "HEMO": ((2021, 2022), "missing years derived by rule"),
    "HOMESUP": ((2021, 2022, 2023, 2024), "missing years left as NaN"),
    "HXDEMENTIA": ((2021, 2022, 2023, 2024), "missing years left as NaN"),
    "HXFALL": ((2021, 2022, 2023, 2024), "missing years left as NaN"),
    "IMMUNO_CAT": ((2021, 2022, 2023, 2024), "missing years left as NaN"),
    "OXYGEN_SUPPORT": ((2021, 2022, 2023, 2024), "missing years left as NaN"),
    "PREOP_COVID": ((2021, 2022, 2023, 2024), "missing years left as NaN"),
    "PREOP_CREAT_MSINCR": ((2022, 2023, 2024), "missing years left as NaN"),
    "PRHEMOGLOBIN": ((2023, 2024), "missing years approximated by rule"),
    "PRHEMO_A1C": ((2023, 2024), "missing years derived by rule"),
    "PRPT": ((2018, 2019, 2020), "missing years left as NaN"),
    "RENAFAIL": ((2018, 2019, 2020, 2022, 2023, 2024), "missing years left as NaN"),
    "WNDINF": ((2018, 2019, 2020), "missing years left as NaN"),
    "WTLOSS": ((2018, 2019, 2020), "missing years left as NaN"),
}

# No training value, so no model input, and masked in the text of every cohort.
TRAINING_EMPTY = ["DPRHEMOGLOBIN", "DPRHEMO_A1C", "PRPT", "DPRPT"]

# The last field of each text passage in the frozen plan.
PASSAGE_ENDS = ["PRCREAT", "HEMO", "WTLOSS"]

# Groups of the availability crosswalk.
CROSSWALK = [
    ("Discontinued", ["DYSPNEA", "WNDINF", "WTLOSS"]),
    ("Introduced or expanded", ["OXYGEN_SUPPORT", "PREOP_COVID"]),
    ("Introduced or expanded", ["RENAFAIL"]),
    ("Introduced or expanded", ["HXDEMENTIA", "HXFALL"]),
    ("Introduced or expanded", ["HOMESUP"]),
    ("Recoded across eras", ["CASETYPE", "EMERGNCY", "ELECTSURG"]),
    ("Recoded across eras", ["HEMO", "PRHEMO_A1C"]),
    ("Cross-cohort measurement", ["PRHEMOGLOBIN"]),
    ("Very low availability", ["PREOP_CREAT_MSINCR"]),
    ("Very low availability", ["IMMUNO_CAT"]),
    ("No training values", ["DPRHEMOGLOBIN", "DPRHEMO_A1C", "PRPT", "DPRPT"]),
]


def years_of(name: str) -> tuple[int, ...]:
    return PARTIAL[name][0] if name in PARTIAL else ALL_YEARS


def model_fields() -> list[str]:
    """The fields that are model inputs, in order."""
    return [c for c in FIELD_LABELS if c not in TRAINING_EMPTY]


def passage_groups() -> list[list[str]]:
    """Contiguous field groups, one per text passage."""
    groups: list[list[str]] = [[]]
    for c in FIELD_LABELS:
        groups[-1].append(c)
        if c in PASSAGE_ENDS[:-1]:
            groups.append([])
    return groups


def build_action(name: str) -> str:
    return PARTIAL[name][1] if name in PARTIAL else "read directly"


def spec_table(spark: SparkSession) -> DataFrame:
    """(position, name, label, years_present, n_years, build_action)."""
    rows = [(i, c, text, list(years_of(c)), len(years_of(c)), build_action(c))
            for i, (c, text) in enumerate(FIELD_LABELS.items())]
    return spark.createDataFrame(
        rows, "position int, name string, label string, years_present array<int>, n_years int,"
              " build_action string")
