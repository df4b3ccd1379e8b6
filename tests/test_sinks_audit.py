import gzip
import json

import pytest

from folioscope import audit, sinks
from folioscope.operators import resample
from folioscope.operators.ranking import ranked_rows
from folioscope.sources import readers

SF = "/root/testdata/sf0.001"


def test_reports(spark, tmp_path):
    out = audit.main(["labels", "--data", SF, "--control", f"again={SF}", "--part", "label_extraction", "--format", "json"], spark)
    made = json.loads(out)
    assert made["label_extraction"] == made["again_label_extraction"] and out.startswith('{\n  "again')
    path = tmp_path / "r.md"
    audit.main(["labels", "--data", SF, "--part", "block_permutations", "--format", "markdown", "--output", str(path)], spark)
    assert "| perm | targets |" in path.read_text()
    assert "perm=1" in audit.main(["labels", "--data", SF, "--part", "block_permutations", "--format", "text"], spark)
    with pytest.raises(ValueError):
        audit.audit(spark, SF, "labels", ["nothing"])
    with pytest.raises(SystemExit):
        audit.parser().parse_args(["labels", "--data", SF, "--control", "=x"])
    known = audit.all_queries()
    assert all(p in known for parts in audit.AUDITS.values() for p in parts)


def test_tables_and_traces(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.0, None), ("a", 1.0, 3)], "name string, bits double, n int")
    sinks.score_table(df, str(tmp_path / "t"), "bits")
    rows = [x for f in sorted((tmp_path / "t").glob("part*")) for x in f.read_text().split()]
    assert rows.index("a") < rows.index("b")
    sinks.trace(df, str(tmp_path / "x.gz"))
    lines = [json.loads(x) for f in (tmp_path / "x.gz").glob("part*.gz") for x in gzip.decompress(f.read_bytes()).splitlines()]
    assert sorted(x["name"] for x in lines) == ["a", "b"] and any(x["n"] is None for x in lines)
    texts = spark.createDataFrame([(2, "cab"), (1, "bad"), (3, None), (4, "")], "k int, t string")
    vocabulary = {r.c: r.id for r in sinks.character_dataset(texts, "t", "k", str(tmp_path / "c"), 0.5).collect()}
    back = {v: k for k, v in vocabulary.items()}
    got = spark.read.parquet(str(tmp_path / "c")).orderBy("pos").collect()
    assert "".join(back[r.id] for r in got) == "badcab" and [r.part for r in got] == ["train"] * 3 + ["val"] * 3
    assert vocabulary == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_readers(spark, tmp_path):
    d = tmp_path / "u"
    d.mkdir()
    (d / "fra-1.utf8").write_bytes("é " .encode() * 5)
    (d / "fra-2.latin").write_bytes("ça va bien là ou ici".encode("latin-1"))
    (d / "deu-1.utf8").write_bytes(b"\xff\xff")
    got = readers.language_files(spark, str(d), {"utf8": "utf-8", "latin": "latin-1"}, {"utf8": 1, "latin": 2}, 3).collect()
    assert [(r.language, r.file, r.words[0]) for r in got] == [("fra", "fra-2.latin", "ça")]
    (d / "m.csv").write_text("x")
    (d / "ita-1.txt").write_text("due parole")
    meta = spark.createDataFrame([("fra-1", "romance")], "name string, family string")
    made = {r.name: (r.family, len(r.words)) for r in readers.comparison_corpora(spark, str(d), meta, 5).collect()}
    assert made == {"fra-1": ("romance", 3), "ita-1": ("unknown", 2)}


def test_ranks_of_hot_and_null_strata(spark):
    rows = [("hot", k) for k in range(900)] + [(None, k) for k in range(50)] + [(f"s{k}", 0) for k in range(40)]
    got = ranked_rows(spark.createDataFrame(rows, "s string, k int").repartition(7), ["s"], ["k"], "r", "n").collect()
    assert len(got) == 990 and all(r.r == r.k for r in got) and {r.n for r in got} == {900, 50, 1}
    assert ranked_rows(spark.createDataFrame([], "s string, k int"), ["s"], ["k"]).count() == 0
    whole = ranked_rows(spark.createDataFrame(rows, "s string, k int"), [], ["k", "s"], "r").collect()
    assert sorted(r.r for r in whole) == list(range(990))


def test_spans_are_disjoint():
    lengths, sizes = [5, 3, 8, 2, 9], [10, 12]
    at = resample.disjoint_spans(lengths, sizes, 3)
    places = [(t, k) for n, p in zip(lengths, at) if p for t, k in [(p[0], p[1] + i) for i in range(n)]]
    assert at[4] and len(places) == len(set(places)) and all(p is None or p[1] + n <= sizes[p[0]] for n, p in zip(lengths, at))
