"""Records of large documents against a parser of whole documents."""

from __future__ import annotations

import json
import random

import pytest

from signalmill.sources import large_json, readers

ODD = ['plain', 'a "quoted" [text] {here}', "back\\slash\\\\", '\\"releases":[', '"', "\\", "é€𝄞", "", "x" * 700, '{"releases":[{', "]}]}" * 5, '\\\\"']


def document(draw: random.Random, n: int) -> list[dict]:
    def value(depth: int):
        kind = draw.randrange(6 if depth < 3 else 3)
        if kind == 3:
            return [value(depth + 1) for _ in range(draw.randrange(4))]
        if kind == 4:
            return {draw.choice(["releases", "a", "b\"c"]): value(depth + 1) for _ in range(draw.randrange(3))}
        return draw.choice([draw.choice(ODD), draw.randrange(10**6), None, True])

    return [{"id": i, "v": value(0), "releases": value(1)} for i in range(n)]


def read(spark, path, field, part_bytes):
    rows = large_json.records(spark, path, field, part_bytes).collect()
    return [json.loads(r.value) for r in sorted(rows, key=lambda r: (r.path, r.at))]


@pytest.mark.parametrize("part_bytes", [61, 1000, 1 << 20])
def test_ranges_give_what_a_parser_gives(spark, tmp_path, part_bytes):
    draw, want = random.Random(5), []
    for k in range(12):
        made = document(draw, draw.choice([0, 1, 7, 25]))
        others = {"before": [{"id": -1}], "named": {"releases": [{"id": -2}]}, "text": '"releases":[{}]'}
        whole = [made, others | {"releases": made, "after": [{"id": -3}], "last": {"x": [[{}]]}}, {"releases": made}][k % 3]
        (tmp_path / f"{k:02d}.json").write_text(json.dumps(whole, indent=draw.choice([None, 1]), ensure_ascii=draw.random() < 0.5), encoding="utf-8")
        want += made
    (tmp_path / "90.json").write_bytes(b"")
    (tmp_path / "91.json").write_bytes(b"\xef\xbb\xbf \n[ {\"id\" : 5} , 3, [ {\"no\":1} ], \"s\", null, {\"id\":6}]")
    (tmp_path / "92.json").write_text('{"id":7,"v":[{"no":1}]}')
    assert read(spark, str(tmp_path), "releases", part_bytes) == want + [{"id": 5}, {"id": 6}, {"id": 7, "v": [{"no": 1}]}]


def test_lines_without_a_field_and_records_cut_short(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":1}\n{"b":"}{"}\n\n{"c":[{"d":2}]}\n{"cut": [1, 2')
    assert read(spark, str(tmp_path), None, 5) == [{"a": 1}, {"b": "}{"}, {"c": [{"d": 2}]}]


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    made = [{"id": i, "v": "x" * 200} for i in range(4000)]
    (tmp_path / "a.json").write_text(json.dumps({"releases": made}))
    found = large_json.records(spark, str(tmp_path), "releases", 50_000)
    from pyspark.sql import functions as F

    spread = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in spread) == 4000 and len(spread) > 8


def test_awards_are_the_same_by_ranges(spark, tmp_path):
    release = lambda i: {"ocid": f"o{i}", "date": "2024-01-01", "buyer": {"id": "b", "name": 'B "x"'}, "awards": [{"id": "a", "date": "2024-02-03", "suppliers": [{"id": "s", "name": f"N{i} [é]"}]}]}
    (tmp_path / "h_20240101_20240107.json").write_text(json.dumps({"releases": [release(i) for i in range(40)]}))
    (tmp_path / "list.json").write_text(json.dumps([release(i) for i in range(40, 60)]))
    (tmp_path / "one.json").write_text(json.dumps(release(99)))
    rows = lambda **k: sorted(map(str, readers.contract_awards(spark, str(tmp_path), **k).collect()))
    assert rows(part_bytes=300) == rows() and len(rows()) == 61
