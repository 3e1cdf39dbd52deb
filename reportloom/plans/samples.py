"""Phrases that queries and their SQL put in place of report texts."""

IVH_NAMES = ["IVH", "ivh", " IVH "]
TYPE_NAMES = ["ICH", "IVH", "PHE", "SAH", "ich", " ICH", "ICH", "No lesions mentioned", "ICH\t", "\u00a0ich"]
SYLLABLES = [("tion", "a"), ("ment", "b"), ("heit", "c"), ("ing", "a"), ("rr", "d"), ("shing", "e")]
FOLDED_SYLLABLES = [("eaux", "a"), ("ecole", "b"), ("cion", "c"), ("uber", "d"), ("ee", "e")]
ICH_PHRASES = ["Parieto-occipital", "Occipital and frontal", "Putamen/Lenticular", "Corona radiata", "U", "Left THALAMUS", "pons, tronc", "Cerebellar", "frontal/front", "insula - temporal"]
IVH_PHRASES = ["Lateral Ventricle/V3/V4", "Lateral Ventricle/Occipital Horn", "Third ventricle", "Ventricles", "U", " fourth /v3", "corne", "cistern"]
SIDES = ["Bilateral/Median/Median", "Left", "U", "right ", "Median/left"]
PHE_PHRASES = ["Modéré", "Severe to mild", "U", "léger", "Œdème VOLUMINEUX", "tiny/large", "4 cm", "Modérée à sévère"]
SEVERITIES = ["mild", "Moderate ", "severe", "mild/severe", "", "mild-moderate"]
SIZE_TAILS = [" mm", " cm", " x 7 cm", " * 3.5 mm", " max mm", ",3 cm", " x 4 x 2 cm", "", ".5", " (3) mm"]
UNITS = ["mm", " CM ", "Millimetre", "centimeter"]
FILE_TAILS = [".json", "_report.json", "_report.legacy.json", "_report_report.json"]
ANSWER_TYPES = ["ICH", " IVH", "U", "", "_"]
PATH_HEADS = ["/x/prompt3/results_", "/x/metrics/prompt3/", "results_", "/r/results_a_", "/y/prompt12/other/"]
PATH_TAILS = ["_prompt3_formated.csv", ".csv", "_prompt44.csv", "_formated", "/prompt7"]
BOOL_TEXTS = ["True", " yes ", "1", "1.0", "0", "t", "", "Y", "false"]
NA_TEXTS = ["None", "N/A", "", "nan", "NaN", "none", "U", "null", "text", "NA "]
