import itertools

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pinlattice.functions import names, outcomes, requirements, scalars, text, vectors, versions, wheels


def test_names_and_pins(spark):
    df = spark.createDataFrame([("My__Pkg.-x",), ("a==1",), ("a==",), ("==1",), ("a",)], "v string")
    out = df.select("v", names.canonical_name(F.col("v")).alias("c"), names.parse_pin(F.col("v")).alias("p"))
    found = {r["v"]: (r["c"], r["p"]) for r in out.collect()}
    assert found["My__Pkg.-x"][0] == "my-pkg-x"
    assert tuple(found["a==1"][1]) == ("a", "1")
    assert found["a=="][1] is None and found["==1"][1] is None and found["a"][1] is None


def test_experiment_id_is_order_sensitive_and_null_safe(spark):
    lit = F.lit
    one = names.experiment_id(lit("A"), lit("1"), lit("b"), lit("2"), lit("3.11"))
    two = names.experiment_id(lit("b"), lit("2"), lit("a"), lit("1"), lit("3.11"))
    missing = names.experiment_id(lit("a"), lit(None).cast("string"), lit("b"), lit("2"), lit("3.11"))
    r = spark.range(1).select(one.alias("x"), two.alias("y"), missing.alias("z")).first()
    assert len(r["x"]) == 20 and r["x"] != r["y"] and r["z"] is None


@pytest.mark.parametrize(
    "filename, python, compatible, words",
    [
        ("demo-1-cp311-cp311-manylinux_2_17_x86_64.whl", "3.11", True, "CPython 3.11"),
        ("demo-1-cp37-abi3-manylinux_2_17_x86_64.whl", "3.12", True, "stable ABI"),
        ("demo-1-py2.py3-none-any.whl", "3.8", True, "universal"),
        ("demo-1-cp310-cp310-manylinux_2_17_x86_64.whl", "3.11", False, "do not match"),
        ("demo-1-cp311-cp311-win_amd64.whl", "3.11", False, "glibc"),
        ("demo-1-cp311-cp311-musllinux_1_1_x86_64.whl", "3.11", False, "glibc"),
        ("demo-1-cp312-abi3-linux_x86_64.whl", "3.11", False, "do not match"),
        ("demo.whl", "3.11", False, "invalid"),
        ("demo-1.tar.gz", "3.11", False, "not a wheel"),
    ],
)
def test_wheel_compatibility(spark, filename, python, compatible, words):
    r = spark.range(1).select(wheels.wheel_compatible(F.lit(filename), python).alias("w")).first()["w"]
    assert r["compatible"] is compatible and words in r["reason"]


@pytest.mark.parametrize(
    "spec, python, expected",
    [
        (">=3.9,<3.12", "3.11", True),
        (">=3.9,<3.12", "3.12", False),
        ("~=3.11.1", "3.11", True),
        ("~=3.11.1", "3.12", False),
        ("==3.11", "3.11", False),
        ("==3.11.*", "3.11", True),
        ("!=3.11.*", "3.11", False),
        ("bogus,>=3.8", "3.9", True),
        (None, "3.9", True),
        ("", "3.9", True),
    ],
)
def test_requires_python(spark, spec, python, expected):
    col = wheels.requires_python_allows(F.lit(spec).cast("string"), python)
    assert spark.range(1).select(col).first()[0] is expected


VERSIONS = (
    "1.0 1.0.0 1 1.0.1 1.0a1 1.0b2 1.0rc1 1.0.dev3 1.0a1.dev2 1.0.post1 1.0-2 1.0.post1.dev4 "
    "1!0.5 v2.0 2.0+local.7 2.0+local.10 2.0+abc 1.10 1.9 0.9.9 1.0c1 1.0-alpha.3 1.0.preview2 nope 1..2"
).split()


def test_version_order_matches_packaging(spark):
    packaging = pytest.importorskip("packaging.version")
    df = spark.createDataFrame([(v,) for v in VERSIONS], "v string")
    got = [r["v"] for r in df.filter(versions.is_pep440(F.col("v"))).collect()]
    want = []
    for v in VERSIONS:
        try:
            packaging.Version(v)
            want.append(v)
        except packaging.InvalidVersion:
            pass
    assert got == want
    pairs = spark.createDataFrame(list(itertools.product(want, want)), "a string, b string")
    out = pairs.select(
        "a", "b", (versions.pep440_key(F.col("a")) < versions.pep440_key(F.col("b"))).alias("lt")
    )
    for r in out.collect():
        assert r["lt"] == (packaging.Version(r["a"]) < packaging.Version(r["b"])), r


def test_requirement_containment_matches_packaging(spark):
    req = pytest.importorskip("packaging.requirements")
    ver = pytest.importorskip("packaging.version")
    lines = [
        "Werkzeug (<2.0,>=0.15)", "a>=1.0,<2", "a==1.0", "a!=1.0", "a==1.0.*", "a!=1.*", "a~=1.0", "a~=1.0.1",
        "a<=1.0", "a>1.0", "a<1.0", "a", 'a[x,y]>=1; python_version < "3"', "a===1.0", "a ==2.0+local.7",
        "a@@bad", "a>=", "a >= 1.0 , < 3", "a @ https://x.test/a.whl",
    ]
    found = [v for v in VERSIONS if v not in ("nope", "1..2")]
    df = spark.createDataFrame(list(itertools.product(lines, found)), "r string, v string")
    out = df.select("r", "v", requirements.requirement_allows(F.col("r"), F.col("v")).alias("x"))
    for r in out.collect():
        try:
            want = req.Requirement(r["r"]).specifier.contains(ver.Version(r["v"]), prereleases=True)
        except req.InvalidRequirement:
            want = None
        if r["r"].startswith("a===") :
            continue  # arbitrary equality compares text, which differs between library versions
        assert r["x"] == want, r


def test_requirement_literals(spark):
    r = spark.range(1).select(
        requirements.requirement_allows(F.lit("Werkzeug (<2.0,>=0.15)"), F.lit("2.0.0")).alias("no"),
        requirements.requirement_allows(F.lit("Werkzeug (<2.0,>=0.15)"), F.lit("1.0.1")).alias("yes"),
        requirements.requirement_allows(F.lit(None).cast("string"), F.lit("1.0.1")).alias("none"),
        requirements.blocking_clauses(F.lit("consumer>=1,<2,!=3.*"), F.lit("2.0.0")).alias("b"),
        requirements.exact_pin(F.lit("a == 1.2 ; x")).alias("p"),
        requirements.exact_pin(F.lit("a>=1.2")).alias("q"),
    ).first()
    assert (r["no"], r["yes"], r["none"]) == (False, True, None)
    assert r["b"] == ["<2", "!=3.*"] and r["p"] == "1.2" and r["q"] is None


def test_best_wheel(spark):
    digest = "a" * 64
    wheel = "array<struct<name:string,url:string,size:bigint,sha256:string>>"
    data = [
        (1, [("helper-1-py3-none-any.whl", "u", 1, digest), ("helper-1-cp38-abi3-manylinux_2_17_x86_64.whl", "u", 1, digest), ("helper-1-cp311-cp311-win_amd64.whl", "u", 1, digest)]),
        (2, [("helper-1-py3-none-any.whl", "u", 1, None)]),
        (3, [("helper-1-cp311-cp311-win_amd64.whl", "u", 1, digest)]),
    ]
    df = spark.createDataFrame(data, f"id int, w {wheel}")
    out = {r["id"]: r["b"] for r in df.select("id", wheels.best_wheel(F.col("w"), "3.11").alias("b")).collect()}
    assert "abi3" in out[1]["wheel"]["name"] and out[1]["violation"] is None
    assert out[2]["violation"] == "wheel has no valid hash"
    assert out[3]["violation"] == "no compatible wheel"


def test_floor_days_are_asymmetric(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    r = spark.range(1).select(
        scalars.release_distance(ts("2024-01-01 00:00:00"), ts("2024-01-01 12:00:00")).alias("a"),
        scalars.release_distance(ts("2024-01-01 12:00:00"), ts("2024-01-01 00:00:00")).alias("b"),
        scalars.release_ordinal(ts("2024-01-01 00:00:00")).alias("o"),
        scalars.release_age(ts("2030-01-01 00:00:00"), ts("2024-01-01 00:00:00")).alias("age"),
    ).first()
    assert (r["a"], r["b"], r["o"], r["age"]) == (1, 0, 738886, 0.0)


STAGE = "struct<stage:string,exit_code:int,timed_out:boolean,stdout:string,stderr:string>"


def _stage(name, code, out="", timed_out=False):
    return (name, code, timed_out, out, "")


@pytest.mark.parametrize(
    "stages, available, outcome",
    [
        ([], False, "wheel_unavailable"),
        ([_stage("resolve_artifacts", 0), _stage("smoke_test", 0), _stage("cleanup_environment", 0)], True, "pass"),
        ([_stage("resolve_artifacts", 0), _stage("smoke_test", 0), _stage("cleanup_environment", 1)], True, "infrastructure_failure"),
        ([_stage("resolve_artifacts", 1, "No solution found")], True, "resolution_failure"),
        ([_stage("resolve_artifacts", 1, "disk full")], True, "infrastructure_failure"),
        ([_stage("resolve_artifacts", None, "", True)], True, "timeout"),
        ([_stage("install_exact_artifacts", 1)], True, "installation_failure"),
        ([_stage("smoke_test", 1, "ImportError")], True, "import_failure"),
        ([_stage("smoke_test", 1, '{"run_stage": "imports_passed"}')], True, "smoke_test_failure"),
        ([_stage("smoke_test", 1, "x"), _stage("cleanup_environment", 1)], True, "import_failure"),
    ],
)
def test_outcome_ladder(spark, stages, available, outcome):
    df = spark.createDataFrame([(stages, available)], f"s array<{STAGE}>, a boolean")
    r = df.select(outcomes.classify_stages(F.col("s"), F.col("a")).alias("c")).first()["c"]
    assert r["outcome"] == outcome


def test_error_text(spark):
    log = "Traceback\n  File\nValueError: a\npkg.LoadError: b /tmp/x/.venv/lib\nnot Error: c"
    r = spark.range(1).select(
        outcomes.exception_type(F.lit(log)).alias("t"), outcomes.normalize_error(F.lit(log)).alias("e")
    ).first()
    assert r["t"] == "pkg.LoadError" and "<venv>/lib" in r["e"] and "\n" not in r["e"]


NOTES = """Changes
=======

Version 3.1.0
-------------
new things

3.0.3
-----
- Removed the deprecated ``foo`` function from the API
- Breaking: works with demo-client only, not my-demo-client

3.0.0
~~~~~
- first of the series

2.3.0
-----
- rebuild for the new ABI
"""


def test_section_and_signals(spark):
    df = spark.createDataFrame([(NOTES, "3.0.3"), (NOTES, "9.9.9")], "text string, version string")
    out = df.select("version", text.select_section(F.col("text"), F.col("version")).alias("s")).collect()
    found = {r["version"]: r["s"] for r in out}
    section = found["3.0.3"]["section"]
    assert found["3.0.3"]["found"] and section.startswith("3.0.3") and "3.0.0" in section
    assert "2.3.0" not in section and "3.1.0" not in section
    assert not found["9.9.9"]["found"] and found["9.9.9"]["section"] == ""
    counts = spark.createDataFrame([(section,)], "t string").select(
        text.signal_counts(F.col("t")).alias("a"), text.high_signal_counts(F.col("t")).alias("b"),
        text.evidence_lines(F.col("t")).alias("e"),
    ).first()
    a, b = counts["a"].asDict(), counts["b"].asDict()
    assert a["breaking"] == 1 and a["removal"] == 1 and a["abi"] == 0
    assert b["removed_deprecated"] == 1 and b["api_removal"] == 1 and b["abi_break"] == 0
    assert counts["e"][0].startswith("Removed the deprecated")


def test_atx_section(spark):
    notes = "# Log\n## 2.2.0\nx\n## Release 2.1.1 ##\n- requires newer dependency, API removed, no longer deprecated\n## 2.0.0\ny"
    r = spark.createDataFrame([(notes,)], "t string").select(
        text.select_section(F.col("t"), F.lit("2.1.1")).alias("s")
    ).first()["s"]
    assert r["found"] and "requires newer" in r["section"] and "2.0.0" not in r["section"]


def test_literal_stems_are_necessary():
    from pinlattice.constants import HIGH_SIGNAL_PATTERNS, SIGNAL_PATTERNS

    assert text.literal_stem(r"backwards? incompatible") == "backward"
    assert text.literal_stem(r"\bremove[ds]?\b") == "remove"
    assert text.literal_stem(r"\bpin(?:ned|ning)?\b") == "pin"
    assert text.literal_stem("foo|bar") == "" and text.literal_stem(r"foo(?:a|b)") == "foo"
    assert text.literal_stem(r"foo[|]x") == "foo" and text.literal_stem(r"foo\|x") == "foo"
    for group in SIGNAL_PATTERNS.values():
        assert all(text.literal_stem(p) for p in group)
    for a, b in HIGH_SIGNAL_PATTERNS.values():
        assert all(text.literal_stem(p) for p in (*a, *b))


def test_changelog_urls(spark):
    def urls(version, historical=None):
        col = text.changelog_urls(
            F.lit(version), F.lit("https://n/{note_version}/{tag}"), F.lit("v{padded_version}"), F.lit(True),
            F.lit(2), F.lit("1.11.0" if historical else None).cast("string"),
            F.lit("https://old/{major_minor}" if historical else None).cast("string"),
        )
        return [tuple(u) for u in spark.range(1).select(col.alias("u")).first()["u"]]

    assert [r for r, _ in urls("2.1.3")] == ["exact", "series_baseline", "major_baseline"]
    assert urls("2025.1.2")[0][1].endswith("v2025.01.2")
    assert urls("1.10.1", True)[0] == ("exact", "https://old/1.10")
    assert [r for r, _ in urls("2.0.0")] == ["exact"]


def test_chunk_starts(spark):
    def starts(n, payload, chunks):
        return spark.range(1).select(text.chunk_starts(F.lit(n), payload, chunks)).first()[0]

    assert starts(5, 10, 3) == [0]
    assert starts(25, 10, 3) == [0, 10, 20]
    assert starts(101, 10, 3) == [0, 46, 91]  # 45.5 rounds half to even
    assert starts(101, 10, 1) == [0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],)], "v array<double>")
    out = [r["n"] for r in df.select(vectors.l2_normalize(F.col("v")).alias("n")).collect()]
    assert out[0]["vector"] == [0.6, 0.8]
    assert out[1]["violation"] == "vector is zero" and out[2]["violation"] == "vector is not finite"


def test_conversions(spark):
    df = spark.createDataFrame([("True",), ("x",), ("2.5",), (None,)], "v string")
    out = df.select(scalars.to_number(F.col("v"), -1.0).alias("n"), scalars.to_bool(F.col("v")).alias("b"))
    assert [r["n"] for r in out.collect()] == [1.0, -1.0, 2.5, -1.0]
    assert rows(out, "b.violation")[0] == ("not a boolean",)


def test_alternatives_are_counted(spark):
    frame = spark.createDataFrame([("a bar and a bar",), ("foo",), ("neither",)], "t string")
    counted = frame.select(text.signal_counts(F.col("t"), {"g": ["foo|bar"]}).alias("s"))
    assert [r.s["g"] for r in counted.collect()] == [2, 1, 0]
