"""Large JSON files read by ranges: the same objects for every number of ranges."""

import json
import random

import pytest

from plumbline.sources.records import read_json_objects
from plumbline.sources.tables import read_annotations, read_scored_claims


@pytest.fixture
def cut(spark):
    """Sets how many bytes a range has, for one test."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, v) for n, v in zip(names, (str(size), "0"))]
    for n, v in old.items():
        spark.conf.set(n, v)


def nested(draw, level=0):
    odd = ['{"', "}}", '\\"', "]", "\\", "é\n", "", '"a": {', "\u0001"]
    pick = draw.randint(0, 5 if level < 3 else 2)
    if pick < 3:
        return draw.choice(odd) + draw.choice(odd)
    if pick == 3:
        return [nested(draw, level + 1) for _ in range(draw.randint(0, 3))]
    return {draw.choice(odd) + str(i): nested(draw, level + 1) for i in range(draw.randint(0, 3))}


def test_every_cut_gives_the_same_objects(spark, cut, tmp_path):
    draw = random.Random(5)
    doc = {f'k"{i}\\' if i % 7 == 0 else f"k{i}": nested(draw) for i in range(150)} | {"long": {"x": "{" * 5000}}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1, ensure_ascii=False), encoding="utf-8")
    size = (tmp_path / "a.json").stat().st_size
    expected = sorted((k, json.dumps(v)) for k, v in doc.items() if isinstance(v, dict))
    for ranges in (1, 7, 60):
        cut(-(-size // ranges))
        got = read_json_objects(spark, str(tmp_path / "a.json")).collect()
        assert sorted((r.key, json.dumps(json.loads(r.value))) for r in got) == expected


def test_annotations_by_ranges(spark, cut, tmp_path):
    entity = lambda i: {"tokens": f"t{i}", "label": "OBS", "start_ix": i, "end_ix": i + 1, "relations": [["located_at", "2"]] if i == 1 else []}
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps({f"{name}{n}": {"text": "x } y", "entities": {str(i): entity(i) for i in range(n % 4)}} for n in range(40)}))
    cut(700)
    entities, relations = read_annotations(spark, str(tmp_path))
    assert entities.count() == 120 and {(r.report_id[0], r.tokens) for r in entities.collect()} == {(f, f"t{i}") for f in "ab" for i in range(3)}
    assert sorted(map(tuple, relations.collect()))[0] == ("a10", "1", "located_at", "2") and relations.count() == 40


def test_claims_with_and_without_a_wrapper(spark, cut, tmp_path):
    rows = [{"claim": f"c{i} }}", "pathology": "p", "patient_id": str(i), "label": 0, "score": i / 8} for i in range(50)]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "wrapped.json").write_text(json.dumps({"meta": {"n": 50}, "claims": rows}))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"claims": rows[i : i + 10]}) for i in range(0, 50, 10)))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text(" [ ] ")
    for size in (300, 1 << 20):
        cut(size)
        for name in ("list", "wrapped", "lines"):
            assert sorted((r.claim, r.score) for r in read_scored_claims(spark, str(tmp_path / f"{name}.json")).collect()) == sorted((r["claim"], r["score"]) for r in rows)
        assert read_scored_claims(spark, str(tmp_path / "e*.json")).count() == read_scored_claims(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text(json.dumps([*rows, {"claim": "c"}]))
    with pytest.raises(Exception, match="lacks a required field"):
        read_scored_claims(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "torn.json").write_text(json.dumps(rows)[:-20])
    with pytest.raises(Exception, match="ends within an object"):
        read_scored_claims(spark, str(tmp_path / "torn.json")).collect()
