"""Sources that may fail and sources that may not."""

import json

import pytest

from mentionforge.operators import publish as P
from mentionforge.sources.raw import Source, read_sources


def lines(path, *rows):
    path.mkdir()
    (path / "a.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


GOOD = {"entity_type": "kpi", "entity_name": "CPU Usage", "alias": "cpu", "confirmation_id": "c1", "other": 5}


def test_an_optional_source_keeps_its_sound_rows(spark, tmp_path):
    bad = ["{", "[1]", "5", "null", {"entity_type": "kpi"}, {"entity_type": " ", "entity_name": ""}, {**GOOD, "alias": ["cpu"]}, {**GOOD, "entity_name": 7}]
    main = lines(tmp_path / "main", GOOD, "", "  ", {**GOOD, "alias": None})
    more = lines(tmp_path / "more", *bad, {"entity_type": "kpi", "entity_name": "cpu usage", "alias": "load"}, {"entity_type": "ne", "entity_name": "名"})
    intake = read_sources(spark, [Source("main", main), Source("more", more, required=False)])
    assert sorted((r.source, r.entity_name) for r in intake.rows.collect()) == [("main", "CPU Usage")] * 2 + [("more", "cpu usage"), ("more", "名")]
    aside = {r.record: r.problem for r in intake.quarantine.collect()}
    texts = [b if isinstance(b, str) else json.dumps(b) for b in bad]
    problems = ["not JSON", "an item is no object", "an item is no object", "an item is no object", "missing: entity_name", "missing: entity_type, entity_name", "wrong type: alias", "wrong type: entity_name"]
    assert aside == dict(zip(texts, problems, strict=True))
    assert [tuple(r) for r in intake.report.collect()] == [("main", True, "ok", 2, 0, None), ("more", False, "degraded", 2, 8, None)]
    entities, found = P.prepare_sources(intake.rows)
    # one entity of two sources; an alias counts only where it is confirmed
    assert sorted((r.entity_id, tuple(r.alias)) for r in entities.collect()) == [("kpi:cpuusage", ("cpu",)), ("ne:名", ())]
    assert [r.error_code for r in found.collect()] == ["name_conflict"]


@pytest.mark.parametrize("kind", ["absent", "no parquet", "torn parquet", "wrong columns", "no columns"])
def test_what_cannot_be_read_fails_its_source_alone(spark, tmp_path, kind):
    path, layout = tmp_path / "bad", "lines" if kind == "absent" else "parquet"
    if kind == "no parquet":
        path.mkdir()
        (path / "x.parquet").write_text("no parquet")
    elif kind == "torn parquet":  # the footer is whole, the pages aren't
        spark.range(50_000).selectExpr("'kpi' as entity_type", "uuid() as entity_name").coalesce(1).write.parquet(str(path))
        (part,) = path.glob("*.parquet")
        data = bytearray(part.read_bytes())
        data[4:100_000] = bytes(99_996)
        part.write_bytes(bytes(data))
        for crc in path.glob(".*.crc"):
            crc.unlink()
    elif kind != "absent":
        spark.range(3).selectExpr("id as entity_name", "'kpi' as entity_type" if kind == "wrong columns" else "id as x").write.parquet(str(path))
    main = lines(tmp_path / "main", GOOD)
    intake = read_sources(spark, [Source("bad", str(path), False, layout), Source("main", main)])
    first, second = intake.report.collect()
    assert first[:5] == ("bad", False, "failed", 0, 0) and first.error and second.status == "ok"
    assert intake.rows.count() == 1 and intake.quarantine.count() == 0
    with pytest.raises(ValueError, match="required source bad"):
        read_sources(spark, [Source("main", main), Source("bad", str(path), True, layout)])


def test_a_bad_row_of_a_required_source_stops(spark, tmp_path):
    path = lines(tmp_path / "main", GOOD, "{")
    with pytest.raises(ValueError, match="required source main has 1 bad rows: .*not JSON"):
        read_sources(spark, [Source("main", path)])
    with pytest.raises(ValueError, match="one name"):
        read_sources(spark, [Source("a", path), Source("a", path)])


def test_sources_without_rows(spark, tmp_path):
    intake = read_sources(spark, [Source("main", lines(tmp_path / "main", ""))])
    assert intake.rows.count() == 0 and [tuple(r) for r in intake.report.collect()] == [("main", True, "ok", 0, 0, None)]
    nothing = read_sources(spark, [])
    assert (nothing.rows.count(), nothing.quarantine.count(), nothing.report.count()) == (0, 0, 0)
