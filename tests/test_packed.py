import pytest
from pyspark.sql import functions as F

from folioscope.operators.packed import resolve_rule, split_packed

EXPORTED = [
    ('["a","b?","c"]', ["a", "b?", "c"]),
    ("('doos',)", ["doos"]),
    ("('x', \"rolkarc'y\", 'y')", ["x", "rolkarc'y", "y"]),
    ("(\"a b\", 'c')", ["a b", "c"]),
    ('{steody,"ottee@184;s",okteedy}', ["steody", "ottee@184;s", "okteedy"]),
    ('{tpcholy,"tte\\"ody"}', ["tpcholy", 'tte"ody']),
    ('"qokee""or"·eoal·tee', ['qokee"or', "eoal", "tee"]),
    ("y@231\\;eey;qodkol;p\\\"chom", ["y@231;eey", "qodkol", 'p"chom']),
    ("oktees;teoar\\,qooiir", ["oktees", "teoar,qooiir"]),
    ("an,oy\\ toeol,dan", ["an", "oy toeol", "dan"]),
    ("ftam chchean\tpooly al", ["ftam", "chchean", "pooly", "al"]),
    ("a, b;c\t?n", ["a", "b", "c", "?n"]),
    ("'otolkol';;'aiin';'a\"b'", ["otolkol", "aiin", 'a"b']),
    (" x ,y , ,z , ", ["x", "y", "z"]),
    ("one/two:three", ["one", "two", "three"]),
    ("[]", []), ("()", []), ("", []), ("  ", []), (";;,", []), (None, []),
    ("a;a;a", ["a", "a", "a"]),
]
RAW = [
    ("<%>daiin.chol,shol<->qokaiin<~>chedy<$>", ["daiin", "chol", "shol", "qokaiin", "chedy"]),
    ("[d:t]aiin.qo?ey.{ch}ol", ["daiin", "qo?ey", "chol"]),
    ("t[{y}:sh].ro[m:r]", ["ty", "rom"]),
    ("fdom{c'y} dar", ["fdomc'y", "dar"]),
    ('dar."dteoly.dar".ochody', ["dar", "dteoly.dar", "ochody"]),
    ('pe<!a "later" hand>.shl"am|"ltom, x"', ["pe", 'shl"am', "ltom, x"]),
    ("<@L=B>yloly-ltam . dol=", ["yloly", "ltam", "dol"]),
    ("ottee@184;s.okteedy oy/", ["otteeU184s", "okteedy", "oy"]),
    ("a{b[c{d[e{f[gh:i]}:j]}:k]}.l", ["abcdefgh", "l"]), ("[[[[[[[x:y]:z]]]]]].w", ["x", "w"]),
    (None, []), ("<!only a comment>", []),
]


def rows(df):
    out = {}
    for r in df.orderBy("id", "pos").collect():
        assert r.pos == len(out.setdefault(r.id, []))
        out[r.id].append(r.value)
    return out


@pytest.mark.parametrize("column,cases", [("exported", EXPORTED), ("transcription", RAW)])
def test_values(spark, column, cases):
    df = spark.createDataFrame([(i, c[0], "clash", 1) for i, c in enumerate(cases)], "id long, f string, value string, pos int")
    got = rows(split_packed(df, "id", **{column: ["f"]}))
    assert got == {i: c[1] for i, c in enumerate(cases) if c[1]}


def test_long_text_and_empty_table(spark):
    df = spark.range(1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), ";").alias("f"))
    assert split_packed(df, "id", exported=["f"]).agg(F.count("*"), F.max("pos")).first()[:] == (50_000, 49_999)
    assert split_packed(df.limit(0), "id", exported=["f"]).count() == 0


def test_rules_are_few_and_stable():
    assert resolve_rule('["\u0001,') == resolve_rule('{"\u0001,')
    assert resolve_rule('"') != resolve_rule('";')
