"""Questions and what is understood of them; a question with a condition that isn't understood is never answered."""

import pytest

from trialspark.plans import router

V = router.Vocabulary(
    sites=("S01", "S03", "S07", "S10"), tests=("HBA1C", "CREAT", "SYSBP", "DIABP", "BILI", "GLUC", "QTCF", "ALT", "AST"), visits=("SCREENING", "BASELINE", "WEEK2"), arms=("PLACEBO", "DRUG"), countries=("GERMANY", "FRANCE", "UNITED STATES"),
    reasons=("WITHDRAWAL BY SUBJECT", "LOST TO FOLLOW-UP", "ADVERSE EVENT"), classes=("SYSTEMIC GLUCOCORTICOID", "SULFONYLUREA", "VITAMIN"),
)
LOW, HIGH = pytest.approx(18, abs=1e-6), pytest.approx(65, abs=1e-6)

QUESTIONS = [
    ("How many subjects are in the study?", "count", {}), ("How many subjects under 18?", "count", {"age": (-1.0, LOW)}), ("How many patients are older than 65?", "count", {"age": (HIGH, 1e9)}), ("Number of participants aged 30 to 40", "count", {"age": (30.0, 40.0)}),
    ("How many subjects aged 65 or older?", "count", {"age": (65.0, 1e9)}), ("How many subjects are between 18 and 65 years old?", "count", {"age": (18.0, 65.0)}), ("How many subjects are younger than 18 at site 3?", "count", {"age": (-1.0, LOW), "site": "S03"}),
    ("How many subjects withdrew?", "count", {"status": "DISCONTINUED", "reason": "WITHDRAW"}), ("How many patients were discontinued due to an adverse event at site 3?", "count", {"status": "DISCONTINUED", "reason": "ADVERSE EVENT", "site": "S03"}),
    ("How many subjects at site S07 discontinued due to an adverse event?", "count", {"status": "DISCONTINUED", "reason": "ADVERSE EVENT", "site": "S07"}), ("Count the S07 subjects who dropped out because of an AE", "count", {"status": "DISCONTINUED", "reason": "ADVERSE EVENT", "site": "S07"}),
    ("How many subjects were lost to follow-up?", "count", {"status": "DISCONTINUED", "reason": "LOST TO FOLLOW-UP"}), ("How many women completed the study?", "count", {"sex": "F", "status": "COMPLETED"}), ("How many male patients are ongoing in the placebo arm?", "count", {"sex": "M", "status": "ONGOING", "arm": "PLACEBO"}),
    ("How many subjects are female?", "count", {"sex": "F"}), ("How many subjects from Germany are on drug?", "count", {"country": "GERMANY", "arm": "DRUG"}), ("How many subjects take a sulfonylurea?", "ambiguous", None), ("How many subjects are taking sulfonylurea?", "count", {"cm_class": "SULFONYLUREA"}),
    ("How many subjects had a dosing error?", "count", {"finding": "DOSING_ERROR"}), ("How many subjects at site 10 never dosed?", "count", {"finding": "MISSING_DOSE", "subcode": "NO_EXPOSURE", "site": "S10"}), ("How many subjects had miscoded serious adverse events?", "count", {"finding": "SERIOUS_AE", "subcode": "SAE_MISCODED"}),
    ("How many subjects had severe adverse events?", "count", {"severity": "SEVERE"}), ("How many subjects have an ALT result at week 4?", "count", {"test": "ALT", "visit": "WEEK4"}), ("How many serious adverse events were reported?", "records", {"finding": "SERIOUS_AE"}),
    ("How many ALT results are recorded at week 2?", "records", {"test": "ALT", "visit": "WEEK2"}), ("How many adverse events were reported since 2024-01-05?", "records", {"dates": ("2024-01-05", None), "domains": ["AE"]}), ("How many lab results between 2024-01-01 and 31-JAN-2024?", "records", {"dates": ("2024-01-01", "2024-01-31"), "domains": ["LB"]}),
    ("Which subjects meet the Hy's law criteria?", "finding", {"finding": "HYS_LAW_CANDIDATE"}), ("list subjects with potential Hy's law", "finding", {"finding": "HYS_LAW_CANDIDATE"}), ("Who shows a drug-induced liver injury signal?", "finding", {"finding": "HYS_LAW_CANDIDATE"}),
    ("Which subjects at site S01 received a wrong dose?", "finding", {"finding": "DOSING_ERROR", "site": "S01"}), ("Which subjects took a prohibited medication?", "finding", {"finding": "PROHIBITED_MEDICATION"}), ("Which female subjects missed a dose?", "finding", {"finding": "MISSING_DOSE", "sex": "F"}),
    ("Which patients had visits outside the visit window at site 1?", "finding", {"finding": "VISIT_WINDOW_DEVIATION", "site": "S01"}), ("List eligibility violations", "finding", {"finding": "ELIGIBILITY_VIOLATION"}), ("Which subjects were enrolled twice?", "finding", {"finding": "DUPLICATE_SUBJECT"}),
    ("Show adverse events before the first dose", "finding", {"finding": "AE_BEFORE_FIRST_DOSE"}), ("Is 042-S07-000012 a Hy's law case?", "finding", {"finding": "HYS_LAW_CANDIDATE", "subject": "042-S07-000012"}), ("Which subjects over 65 had serious adverse events?", "finding", {"finding": "SERIOUS_AE", "age": (HIGH, 1e9)}),
    ("List the laboratory and adverse-event records for 042-S05-000003 within 7 days of the WEEK8 visit", "lookup", {"subject": "042-S05-000003", "visit": "WEEK8", "days": 7, "domains": ["AE", "LB"]}), ("Show demographics of subject 042-S01-000001", "lookup", {"subject": "042-S01-000001", "domains": ["DM"]}),
    ("Show the vital signs of 042-S01-000001 at baseline", "lookup", {"subject": "042-S01-000001", "domains": ["VS"], "visit": "BASELINE"}), ("ECG records of 042-S01-000001", "lookup", {"subject": "042-S01-000001", "domains": ["EG"]}), ("List systolic blood pressure for 042-S01-000001", "lookup", {"subject": "042-S01-000001", "test": "SYSBP", "domains": ["VS"]}),
    ("List the concomitant medications of 042-S01-000001", "lookup", {"subject": "042-S01-000001", "domains": ["CM"]}), ("Show bilirubin at site 7", "lookup", {"test": "BILI", "site": "S07"}), ("Show the medical history of 042-S01-000001", "lookup", {"subject": "042-S01-000001", "domains": ["MH"]}), ("List disposition records at site S03", "lookup", {"domains": ["DS"], "site": "S03"}),
    ("Give me an overview of 042-S01-000001", "patient360", {"subject": "042-S01-000001"}), ("Everything about 042-S07-000012", "patient360", {"subject": "042-S07-000012"}),
    ("What is the visit window in the protocol?", "doc", {}), ("what does the lab manual say to automated reviewers?", "doc", {}), ("What changed between protocol versions 1 and 2?", "doc", {}), ("What is the visit window?", "doc", {}),
    # conditions that no slot knows
    ("blorp fizz wumble", "unknown", None), ("How many left-handed subjects discontinued?", "ambiguous", None), ("How many subjects at site S07 had a purple rash?", "ambiguous", None), ("Which subjects with a dosing error like chess?", "ambiguous", None),
    ("How many subjects had ALT above 3 times the upper limit?", "ambiguous", None), ("Which subjects had a dosing error in March?", "ambiguous", None), ("Show ALT within 7 days", "ambiguous", None), ("How many subjects at sites 3 and 4?", "ambiguous", None), ("Which subjects had a dosing error at week 4?", "ambiguous", None), ("How many subjects since 2024-01-05?", "ambiguous", None),
]


@pytest.mark.parametrize("text, kind, slots", QUESTIONS, ids=[q[0][:40] for q in QUESTIONS])
def test_what_is_understood(text, kind, slots):
    i = router.classify(text, V)
    gone = router.unused(i)
    if slots is None:
        assert gone, i
        return
    assert not gone, (gone, i)
    assert ("records" if i.records else i.kind) == kind
    told = {k: getattr(i, k) for k in ("subject", "site", "visit", "days", "test", "domains", "finding", "subcode", "dates") if getattr(i, k)} | {k: v for k, v in i.filters.items() if not k.startswith("_")}
    if "domains" not in slots and kind == "count":
        told.pop("domains", None)
    assert told == slots
