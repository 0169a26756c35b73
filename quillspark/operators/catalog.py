"""The catalogue of document types, their keywords and fields, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Document types, what they are called, and the printed words they are known by.
TYPES = (
    ("aadhaar_card", "Aadhaar Card", ("aadhaar", "unique identification authority", "uidai", "enrollment", "enrolment", "mera aadhaar")),
    ("pan_card", "PAN Card", ("permanent account number", "income tax department", "income tax")),
    ("driving_licence", "Driving Licence", ("driving licence", "driving license", "licencing authority", "classes of vehicles", "valid till")),
    ("passport", "Passport", ("passport", "republic of india", "p<ind", "date of expiry", "place of issue", "country code")),
    ("nach_ecs_mandate", "NACH/ECS Mandate", ("nach", "mandate", "umrn", "ifsc", "micr", "sponsor bank", "ecs", "debit")),
    ("fatca_annexure", "FATCA Annexure Form", ("annexure", "285ba", "tax residency", "tax identification number", "fatca", "country of birth")),
    ("benefit_illustration_declaration", "Benefit Illustration Declaration", ("benefit illustration", "customer declaration", "assumed future investment returns")),
    ("moral_hazard_questionnaire", "Moral Hazard Questionnaire", ("moral hazard", "questionnaire", "nominee", "dependent")),
    ("multiple_policies_consent", "Multiple Policies Consent Form", ("multiple policies", "split", "consent form", "reason for buying")),
    ("suitability_profiler_declaration", "Suitability Profiler Declaration", ("suitability profiler", "suitability", "agent/sp", "product recommendation")),
)
UNKNOWN = "unknown_or_other"

# For each type its fields: name, label, kind, rule, anchors, region; options and whether auxiliary where they matter.
FREQUENCIES = ("Monthly", "Quarterly", "Half-Yearly", "Yearly", "As & when presented")
REASONS = ("Financial Planning", "Different investment / protection needs", "Separate policy purchased for different beneficiary", "Others")
FIELDS = (
    ("aadhaar_card", "aadhaar_number", "Aadhaar Number", "printed", "aadhaar", ("Aadhaar Number",), "right"),
    ("aadhaar_card", "full_name", "Full Name", "printed", "name", ("Name",), "below"),
    ("aadhaar_card", "date_of_birth", "Date of Birth", "printed", "date_past", ("Date of Birth", "DOB"), "below"),
    ("aadhaar_card", "address", "Address", "printed", "address", ("Address",), "below"),
    ("pan_card", "pan_number", "PAN Number", "printed", "pan", ("Permanent Account Number",), "below"),
    ("pan_card", "full_name", "Full Name", "printed", "name", ("Name",), "below"),
    ("pan_card", "fathers_name", "Father's Name", "printed", "name", ("Father's Name", "Fathers Name"), "below"),
    ("pan_card", "date_of_birth", "Date of Birth", "printed", "date_past", ("Date of Birth",), "below"),
    ("driving_licence", "dl_number", "DL Number", "printed", "dl", ("DL No",), "right"),
    ("driving_licence", "name", "Name", "printed", "name", ("Name",), "right"),
    ("driving_licence", "date_of_issue", "Date of Issue", "printed", "date_past", ("Date of Issue", "DOI"), "right"),
    ("driving_licence", "valid_till", "Valid Till", "printed", "date", ("Valid Till",), "right"),
    ("passport", "passport_number", "Passport Number", "printed", "passport", ("Passport No",), "below"),
    ("passport", "date_of_birth", "Date of Birth", "printed", "date_past", ("Date of Birth",), "below"),
    ("passport", "date_of_expiry", "Date of Expiry", "printed", "date", ("Date of Expiry",), "below"),
    ("passport", "mrz_line_2", "MRZ Line 2", "printed", "mrz2", ("<<<",), "row"),
    ("nach_ecs_mandate", "bank_account_number", "Bank Account Number", "handwritten", "account", ("Bank a/c number", "a/c number"), "right_wide"),
    ("nach_ecs_mandate", "ifsc_code", "IFSC Code", "handwritten", "ifsc", ("IFSC",), "right"),
    ("nach_ecs_mandate", "bank_name", "Bank Name", "handwritten", "text", ("with bank",), "right_wide"),
    ("nach_ecs_mandate", "amount_in_figures", "Amount in figures", "handwritten", "amount", ("₹", "or MICR"), "right"),
    ("nach_ecs_mandate", "frequency", "Frequency", "checkbox", "checkbox", ("FREQUENCY",), "row", FREQUENCIES),
    ("nach_ecs_mandate", "amount_in_words", "Amount in words", "handwritten", "text", ("amount of Rupees",), "right_wide", (), True),
    ("fatca_annexure", "policy_number", "Policy Number", "handwritten", "digits", ("Policy No",), "right"),
    ("fatca_annexure", "tin_pan", "TIN/PAN", "handwritten", "pan", ("Tax Identification Number", "Functional equivalent"), "below"),
    ("fatca_annexure", "fathers_name", "Father's Name", "handwritten", "name", ("Father's Name",), "right"),
    ("fatca_annexure", "place_of_birth", "Place of Birth", "handwritten", "place", ("Place of birth",), "right"),
    ("fatca_annexure", "nationality", "Nationality", "handwritten", "text", ("Nationality",), "right"),
    ("benefit_illustration_declaration", "application_number", "Application Number", "handwritten", "digits", ("Proposal Form Number", "Application/"), "right"),
    ("benefit_illustration_declaration", "policyholder_name", "Policyholder Name", "handwritten", "name", ("Name of Policyhoder", "Name of Policyholder"), "right"),
    ("benefit_illustration_declaration", "date", "Date", "handwritten", "date_form", ("Date",), "right"),
    ("benefit_illustration_declaration", "place", "Place", "handwritten", "place", ("Place",), "right"),
    ("moral_hazard_questionnaire", "application_number", "Application Number", "handwritten", "digits", ("Application No",), "right"),
    ("moral_hazard_questionnaire", "name_of_life_assured", "Name of Life Assured", "handwritten", "name", ("Name of the Life to be Assured",), "right"),
    ("moral_hazard_questionnaire", "nominee_relationship", "Nominee Relationship", "handwritten", "text", ("exact relationship",), "right"),
    ("moral_hazard_questionnaire", "date", "Date", "handwritten", "date_form", ("Date",), "right"),
    ("moral_hazard_questionnaire", "place", "Place", "handwritten", "place", ("Place",), "right"),
    ("multiple_policies_consent", "proposer_name", "Proposer Name", "handwritten", "name", ("Life Assured Name", "Proposer"), "right"),
    ("multiple_policies_consent", "reason_for_multiple_policies", "Reason for multiple policies", "checkbox", "checkbox", ("Reason for buying multiple policies",), "below", REASONS),
    ("multiple_policies_consent", "date", "Date", "handwritten", "date_form", ("Date",), "right"),
    ("multiple_policies_consent", "place", "Place", "handwritten", "place", ("Place",), "right"),
    ("suitability_profiler_declaration", "application_number", "Application Number", "handwritten", "digits", ("Proposal Form Number",), "right"),
    ("suitability_profiler_declaration", "name_of_life_assured", "Name of Life Assured", "handwritten", "name", ("Name of Life Assured",), "right"),
    ("suitability_profiler_declaration", "name_of_agent_sp", "Name of Agent/SP", "handwritten", "name", ("Name of Agent/SP",), "right"),
    ("suitability_profiler_declaration", "date", "Date", "handwritten", "date_form", ("Date",), "right"),
    ("suitability_profiler_declaration", "place", "Place", "handwritten", "place", ("Place",), "right"),
)


def doc_specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, name) for t, name, _ in TYPES], "doc_type string, display string")


def doc_keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, k) for t, _, words in TYPES for k in words], "type string, keyword string")


def field_specs(spark: SparkSession) -> DataFrame:
    rows = [(*f[:2], i, *f[2:5], list(f[5]), f[6], list(f[7]) if len(f) > 7 else [], len(f) > 8 and f[8]) for i, f in enumerate(FIELDS)]
    return spark.createDataFrame(rows, "doc_type string, field string, ord int, label string, kind string, validator string, anchors array<string>, region string, options array<string>, auxiliary boolean")
