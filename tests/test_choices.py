"""Section choice, letter codes and the hold-out by patient."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import conformal as C


def test_section_choice(spark):
    texts = ["FINDINGS: a b. IMPRESSION: c.", "IMPRESSION: c.", "plain text ", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: tuple(r)[1:] for r in rows.select("i", *(T.chosen_section(F.col("t"), w) for w in ("findings", "impression", "both", "full"))).collect()}
    assert got == {0: ("a b.", "c.", "a b. c.", texts[0]), 1: ("", "c.", "c.", texts[1]), 2: ("plain text", "plain text", "plain text plain text", "plain text"), 3: ("",) * 4, 4: ("",) * 4}
    with pytest.raises(ValueError):
        T.chosen_section(F.col("t"), "history")


def test_letter_codes(spark):
    rows = spark.createDataFrame([(c,) for c in ["s", " C\n", "P", "h", "u", "q", "", None, "su"]], "c string")
    got = rows.select(T.label_of_letter(F.col("c")), T.sureness_of_letter(F.col("c"))).collect()
    assert [r[0] for r in got] == ["SUPPORTED", "CONTRADICTED", "NOVEL_PLAUSIBLE", "NOVEL_HALLUCINATED", "UNCERTAIN", None, None, None, None]
    assert [r[1] for r in got] == ["medium", "medium", "medium", "high"] + ["medium"] * 5


def test_hold_out(spark):
    rows = spark.createDataFrame([(f"c{i}", None if i % 10 == 0 else i % 40) for i in range(200)], "claim_id string, patient_id int")
    got = C.hold_out(rows, 0.1, 7).collect()
    assert len(got) == 200
    sides = {}
    for r in got:
        sides.setdefault(r.claim_id if r.patient_id is None else r.patient_id, set()).add(r.is_val)
    assert all(len(s) == 1 for s in sides.values()) and sum(s == {True} for s in sides.values()) == len(sides) // 10
    few = C.hold_out(rows.where("patient_id in (1, 2)"), 0.1, 7)
    assert few.where("is_val").select("patient_id").distinct().count() == 1
    assert C.hold_out(rows.limit(0), 0.1, 7).count() == 0
