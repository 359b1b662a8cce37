import json
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pinlattice import schemas
from pinlattice.constants import LABEL_COLUMNS
from pinlattice.operators.catalog import audit_scope, coverage_summary, eligible_versions, explode_project_files, normalize_release, published_versions
from pinlattice.operators.scoring import post_install_decision
from pinlattice.plans import advisor as adv
from pinlattice.plans import features as ft
from pinlattice.operators.violations import ContractError
from pinlattice.sources import manifests, readers, writers
from pinlattice.streaming import conversations as conv
from pinlattice.streaming import observations as so


def write(folder, name, value):
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(value if isinstance(value, str) else json.dumps(value))
    return path


def payload(version="1.0.0", requires=">=3.10,<3.12", dist=(), name="demo", yanked=False, file="demo-{v}-py3-none-any.whl"):
    return {
        "info": {"name": name, "version": version, "requires_python": requires, "requires_dist": list(dist), "yanked": yanked},
        "urls": [
            {"packagetype": "bdist_wheel", "filename": file.format(v=version), "url": "u", "size": 10, "digests": {"sha256": "a" * 64},
             "upload_time_iso_8601": "2024-01-02T00:00:00Z", "yanked": False},
            {"packagetype": "sdist", "filename": f"demo-{version}.tar.gz", "size": 9, "upload_time_iso_8601": "2024-01-01T00:00:00Z"},
        ],
    }


def lines(items):
    return "\n".join(json.dumps(i) for i in items) + "\n\n"


def test_release_payload(spark, folder):
    path = write(folder, "p.jsonl", lines([payload()]))
    raw = readers.read_jsonl(spark, path, schemas.RAW_RELEASE)
    out = {r["python_version"]: r["release"] for r in normalize_release(raw, ["3.11", "3.12"]).collect()}
    assert len(out["3.11"]["wheels"]) == 1 and out["3.11"]["wheels"][0]["compatible"]
    assert out["3.11"]["release_date"] == "2024-01-01T00:00:00Z"
    wheel = out["3.12"]["wheels"][0]
    assert not wheel["compatible"] and "Requires-Python" in wheel["compatibility_reason"]


def test_coverage(spark, folder):
    items = [payload("1.0.0", None), payload("2.0.0", None, file="demo-{v}-cp311-cp311-linux_x86_64.whl")]
    raw = readers.read_jsonl(spark, write(folder, "p.jsonl", lines(items)), schemas.RAW_RELEASE)
    audited = audit_scope(normalize_release(raw, ["3.10", "3.11", "3.12"]))
    s = coverage_summary(audited).first()
    assert (s["releases"], s["eligible_targets"], s["excluded_targets"]) == (2, 4, 2)
    assert rows(audited.filter("not eligible"), "reason") == [("incompatible_wheel_tags",)] * 2


def test_project_files(spark, folder):
    def file(name, at="2024-01-01T00:00:00Z", yanked=False):
        return [{"filename": f"demo-{name}-py3-none-any.whl", "yanked": yanked, "upload_time_iso_8601": at}]

    releases = {
        "1.0.0": file("1"), "1.1.0.post1": file("2"), "2.0.0rc1": file("3"), "2.0.0.dev1": file("4"),
        "2.0.0": file("5", yanked=True), "3.0.0": file("6", "2999-01-01T00:00:00Z"), "not-a-version": file("7"), "4.0.0": [],
    }
    raw = readers.read_jsonl(spark, write(folder, "p.jsonl", lines([{"info": {"name": "Demo"}, "releases": releases}])), schemas.RAW_PROJECT)
    cutoff = F.lit("2026-01-01").cast("timestamp")
    assert rows(published_versions(raw, cutoff)) == [("demo", "1.0.0"), ("demo", "1.1.0.post1")]
    assert rows(eligible_versions(raw, ["3.11"], cutoff)) == [("demo", "1.0.0"), ("demo", "1.1.0.post1")]
    assert explode_project_files(raw).filter("file is null").count() == 1


def test_scope_reader_takes_strings_and_objects(spark, folder):
    scope = {
        "coverage_order": ["3.9", "3.10"],
        "packages": {
            "a": {"role": "lib", "versions": ["1.0", {"version": "1.10", "coverage": [True, False], "coverage_details": [
                {"python": "3.9", "eligible": True, "reason": "eligible", "compatible_wheels": 2},
                {"python": "3.10", "eligible": False, "reason": "yanked_release", "compatible_wheels": 0}]}]},
            "b": {"role": "app", "versions": [{"version": "3.0", "coverage": [True, True]}]},
        },
    }
    out = readers.read_scope(spark, write(folder, "s.json", scope))
    got = {(r["package"], r["version"], r["python_version"]): (r["eligible"], r["reason"], r["compatible_wheels"]) for r in out.collect()}
    assert got[("a", "1.10", "3.10")] == (False, "yanked_release", 0)
    assert got[("a", "1.0", "3.9")][0] is None and got[("b", "3.0", "3.10")] == (True, "eligible", 1)
    bad = readers.scope_problems(spark, write(folder, "s2.json", scope))
    assert rows(bad, "rule", "key") == [("coverage_mismatch", "a==1.0")] * 2


def test_strict_and_tolerant_jsonl(spark, folder):
    path = write(folder, "x.jsonl", '{"id": 1}\n\n{"id": \n{"id": 3}\n')
    good, bad = readers.read_jsonl_tolerant(spark, path, "id int")
    assert rows(good) == [(1,), (3,)] and rows(bad) == [('{"id": ',)]
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        readers.read_jsonl(spark, path, "id int").collect()
    assert readers.read_jsonl(spark, f"{folder}/none", "id int").count() == 0


def test_csv_keeps_python_versions(spark, folder):
    df = spark.createDataFrame([("3.10", 1.5), ("3.9", None)], "python_version string, x double")
    writers.write_features(df, f"{folder}/csv", "csv")
    back = readers.read_features_csv(spark, f"{folder}/csv", ["x", "python_version"], ["python_version"])
    assert rows(back) == rows(df) and dict(back.dtypes)["x"] == "double"


def test_rewrite_resume_and_checksums(spark, folder):
    df = spark.createDataFrame([(i,) for i in range(5)], "id int")
    path = f"{folder}/t"
    assert writers.rewrite_table(df, path) == 1
    begun = writers.read_current(spark, path)
    assert writers.rewrite_table(begun.filter("id > 2"), path) == 2
    assert rows(writers.read_current(spark, path)) == [(3,), (4,)] and begun.count() == 5
    # A rewrite that fails, or that has not published, leaves the table as it is.
    with pytest.raises(Exception):
        writers.rewrite_table(begun.select(F.raise_error(F.lit("broken")).alias("id")), path)
    df.write.parquet(f"{path}/data-9-unpublished")
    assert rows(writers.read_current(spark, path)) == [(3,), (4,)]
    assert writers.rewrite_table(writers.read_current(spark, path).limit(0), path) == 3
    assert writers.read_current(spark, path).count() == 0
    with pytest.raises(FileNotFoundError):
        writers.read_current(spark, f"{folder}/none")
    calls = []

    def compute(missing):
        calls.append(missing.count())
        return missing

    writers.resume_write(df.filter("id < 2"), f"{folder}/r", ["id"], compute)
    stored = writers.resume_write(df.unionByName(df), f"{folder}/r", ["id"], compute)
    assert rows(stored) == rows(df) and calls == [2, 3]
    writers.resume_write(df, f"{folder}/r", ["id"], compute)
    assert calls[-1] == 0
    write(folder, "f.txt", "hello")
    sums = manifests.file_checksums(spark, folder, "f.txt")
    assert rows(sums, "file", "bytes") == [("f.txt", 5)]
    assert manifests.verify_frozen(sums.select("file", "sha256"), sums).count() == 0


def experiment(**extra):
    return {"experiment_id": "e1", "matrix_order": 1, "family": "f", "package_a": "consumer", "version_a": "1.0.0", "package_b": "Provider", "version_b": "2.0.0", "python_version": "3.11", **extra}


def catalog(spark, folder):
    items = [payload("1.0.0", None, ["other>1", 'provider<2; extra == "x"'], "Consumer"), payload("2.0.0", None, [], "provider")]
    raw = readers.read_jsonl(spark, write(folder, "c.jsonl", lines(items)), schemas.RAW_RELEASE)
    return normalize_release(raw, ["3.11"])


def test_features_without_leakage(spark, folder):
    cat = catalog(spark, folder)
    labelled = spark.createDataFrame([experiment(outcome="import_failure")])
    frame = ft.large_features(labelled, cat)
    r = frame.first()
    assert r["published_constraint_blocked"] and r["package_a_requirement_on_b"].startswith("provider<2")
    assert r["is_failure"] and r["failure_stage"] == "post_install" and not any("error" in c for c in frame.columns)
    blind = ft.blind_inputs(labelled, cat)
    assert not set(blind.columns) & set(LABEL_COLUMNS)
    ft.leakage_guard(ft.model_columns(frame), [blind])
    with pytest.raises(ContractError):
        ft.leakage_guard(["x_duration"], [])
    with pytest.raises(ContractError):
        ft.leakage_guard([], [frame])
    with pytest.raises(ContractError):
        ft.leakage_guard(["a"], [], ["a", "b"])
    missing = spark.createDataFrame([experiment(experiment_id="e2", version_a="9.9")])
    _, problems = ft.join_catalog(missing, ft.release_facts(cat))
    assert rows(problems, "rule", "key") == [("release_a_not_in_catalog", "e2")]
    roles = {x["column"]: x["role"] for x in ft.column_roles(frame).collect()}
    assert roles["outcome"] == "label" and roles["family"] == "identifier"
    assert roles["package_a_wheel_bytes"] == "inference-safe feature"


def feature(a, va, b, vb, structured, imp, smoke=0.0, blocked=False, python="3.11"):
    return {
        "package_a_name": a, "package_a_version": va, "package_b_name": b, "package_b_version": vb, "python_version": python,
        "experiment_id": f"{a}{va}{b}{vb}", "listed": 0, "package_a_declares_package_b": blocked, "package_a_requirement_allows_b": not blocked,
        "package_b_declares_package_a": False, "package_b_requirement_allows_a": False, "structured_probability": structured,
        "import_probability": imp, "smoke_probability": smoke,
    }


def run_cascade(spark, features, resolvable):
    df = post_install_decision(adv.with_constraints(spark.createDataFrame(features)))
    df = df.select(*adv._key_columns(), "experiment_id", "listed", *adv.SCORES)
    requests = spark.createDataFrame([(1, "3.11", "Alpha", "2.0")], "request_id int, python_version string, target_package string, requested_version string")
    env = spark.createDataFrame([(1, "3.11", "alpha", "1.0"), (1, "3.11", "beta", "1.0")], "env_id int, python_version string, package string, version string")
    keys = []
    for va in ("1.0", "2.0"):
        for vb in ("1.0", "2.0"):
            pins = spark.createDataFrame([(0, "alpha", va), (0, "beta", vb)], "env_id int, package string, version string")
            keys.append(adv.environment_keys(pins).withColumn("resolvable", F.lit(resolvable.get((va, vb))).cast("boolean")))
    verdicts = keys[0]
    for k in keys[1:]:
        verdicts = verdicts.unionByName(k)
    status, accepted, warnings, problems = adv.advise(requests, env, df, verdicts.drop("env_id"))
    return status.first(), accepted.orderBy("recommendation").collect(), warnings.first()


def grid(risk):
    return [feature("alpha", a, "beta", b, 0.1, risk) for a in ("1.0", "2.0") for b in ("1.0", "2.0")]


def test_cascade_accepts_resolved_low_risk(spark):
    status, accepted, _ = run_cascade(spark, grid(0.05), {(a, b): True for a in ("1.0", "2.0") for b in ("1.0", "2.0")})
    assert status["status"] == "no_risk_predicted"
    assert len(accepted) == 3 and accepted[0]["target_version"] == "2.0" and accepted[0]["versions"] == ["1.0"]
    assert accepted[0]["category"] == "achieves_requested_change"


def test_requests_that_break_a_rule_get_no_advice(spark):
    df = post_install_decision(adv.with_constraints(spark.createDataFrame(grid(0.05))))
    df = df.select(*adv._key_columns(), "experiment_id", "listed", *adv.SCORES)
    schema = "request_id int, python_version string, target_package string, requested_version string"
    requests = spark.createDataFrame([(1, "3.11", "Alpha", "2.0"), (2, "2.7", "alpha", "2.0"), (3, "3.11", "alpha", "2.0"), (4, "3.11", "alpha", "2.0")], schema)
    pins = [(i, "3.11", p, "1.0") for i in (1, 2) for p in ("alpha", "beta")] + [(3, "3.11", "alpha", "one"), (3, "3.11", "beta", "1.0")]
    pins += [(4, "3.11", f"p{i}", "1.0") for i in range(100)] + [(4, "3.11", "alpha", "1.0")]
    env = spark.createDataFrame(pins, "env_id int, python_version string, package string, version string")
    verdicts = adv.environment_keys(env.filter("env_id = 1")).withColumn("resolvable", F.lit(True)).drop("env_id")
    status, accepted, _, problems = adv.advise(requests, env, df, verdicts)
    assert rows(status, "env_id") == [(1,)] and {r.request_id for r in accepted.collect()} <= {1}
    assert rows(problems, "rule", "key") == [("invalid_pin_version", "3"), ("too_many_pins", "4"), ("unsupported_python", "2")]


def test_cascade_rejects_unresolved(spark):
    status, accepted, warning = run_cascade(spark, grid(0.05), {(a, b): False for a in ("1.0", "2.0") for b in ("1.0", "2.0")})
    assert status["status"] == "risk_found" and not accepted and warning["warning"] == "all_rejected"


def test_cascade_unknown_and_risky(spark):
    status, accepted, warning = run_cascade(spark, grid(0.05), {})
    assert status["status"] == "resolver_unavailable" and not accepted and warning["warning"] == "verdicts_unavailable"
    status, accepted, warning = run_cascade(spark, grid(0.9), {(a, b): True for a in ("1.0", "2.0") for b in ("1.0", "2.0")})
    assert status["status"] == "risk_found" and not accepted and warning["warning"] == "removed_by_risk_policy"


def test_find_pair_prefers_the_asked_orientation(spark):
    both = [feature("a", "1", "b", "1", 0.1, 0.1), feature("b", "1", "a", "1", 0.2, 0.1)]
    df = spark.createDataFrame(both)
    pairs = spark.createDataFrame([("a", "1", "b", "1", "3.11"), ("b", "1", "a", "1", "3.11"), ("a", "2", "b", "1", "3.11")],
                                  "left string, left_version string, right string, right_version string, python_version string")
    got = {(r["left"], r["left_version"]): r["row"] for r in adv.find_pair(pairs, df).collect()}
    assert got[("a", "1")]["package_a_name"] == "a" and got[("b", "1")]["package_a_name"] == "b" and got[("a", "2")] is None


def test_beam_expansion_matches_brute_force(spark):
    import itertools
    import random

    r = random.Random(8)
    names = [f"p{i}" for i in range(5)]
    opts = {n: [(k + 1, f"{k}.0", k > 0, round(r.random(), 3)) for k in range(3)] for n in names}
    related = spark.createDataFrame([(1, "3.11", "t", n, "0.0") for n in names], "request_id int, python_version string, target string, related string, current_version string")
    options = spark.createDataFrame(
        [("3.11", "t", n, "0.0", "9.0", o, v, c, x) for n, vs in opts.items() for o, v, c, x in vs],
        "python_version string, target string, related string, current_version string, target_version string, option int, related_version string, changed boolean, risk double",
    )
    got = [(x["related_changes"], x["risk"], tuple(x["versions"])) for x in adv.expand_candidates(related, options, beam=20).collect()]
    states = [(0, 0.0, ())]
    for n in names:
        grown = [(c + ch, max(k, x), v + (ver,)) for (c, k, v), (_, ver, ch, x) in itertools.product(states, opts[n])]
        states = sorted(grown)[:20]
    assert sorted(got) == states


@pytest.mark.parametrize("packages", [3, 6])
def test_best_candidates_equal_the_ranked_product(spark, packages):
    """Beams of 20 and 50 cut here: up to 3 ** 6 combinations for each of 9 target versions."""
    import random

    r = random.Random(packages)
    names = [f"p{i}" for i in range(packages)]
    targets = [f"{m}.{n}" for m in range(3) for n in range(3)]
    related = spark.createDataFrame([(q, "3.11", "t", n, "1.0") for q in (1, 2) for n in names], "request_id int, python_version string, target string, related string, current_version string")
    data = [("3.11", "t", n, "1.0", v, k + 1, f"{k}.0", k != 1, round(r.random(), 2)) for v in targets for n in names for k in range(3)]
    options = spark.createDataFrame(data + data[:5], "python_version string, target string, related string, current_version string, target_version string, option int, related_version string, changed boolean, risk double")
    requests = spark.createDataFrame([(1, "3.11", "t", "1.1"), (2, "3.11", "t", "2.0")], "request_id int, python_version string, target_package string, requested_version string")
    env = spark.createDataFrame([(q, "3.11", "t", "1.0") for q in (1, 2)], "env_id int, python_version string, package string, version string")
    columns = ("request_id", "position", "target_version", "versions", "priority", "changes", "risk")
    for limit in (4, 20, 50):
        whole = adv.rank_candidates(adv.expand_candidates(related, options, limit), requests, env, limit)
        best = adv.best_candidates(related, options, requests, env, limit)
        assert rows(best, *columns) == rows(whole, *columns) and best.count() == 2 * limit


@pytest.mark.parametrize("beam", [2, 50])
def test_candidates_of_one_related_package(spark, beam):
    related = spark.createDataFrame([(1, "3.11", "t", "p", "1.0")], "request_id int, python_version string, target string, related string, current_version string")
    options = spark.createDataFrame(
        [("3.11", "t", "p", "1.0", "9.0", 1, "1.0", False, 0.7), ("3.11", "t", "p", "1.0", "9.0", 2, "3.0", True, 0.5), ("3.11", "t", "p", "1.0", "9.0", 3, "2.0", True, None)],
        "python_version string, target string, related string, current_version string, target_version string, option int, related_version string, changed boolean, risk double",
    )
    got = adv.expand_candidates(related, options, beam)
    expected = sorted([(0, 0.7, ["1.0"]), (1, 0.0, ["2.0"]), (1, 0.5, ["3.0"])])[:beam]
    assert sorted(map(tuple, got.select("related_changes", "risk", "versions").collect())) == expected


def test_options_are_made_once_for_the_ranking(spark, capsys):
    related = spark.createDataFrame([(q, "3.11", "t", n, "1.0") for q in (1, 2) for n in "ab"], "request_id int, python_version string, target string, related string, current_version string")
    data = [("3.11", "t", n, "1.0", v, 1, "1.0", False, 0.5) for v in ("1.0", "2.0") for n in "ab"]
    shape = "python_version string, target string, related string, current_version string, target_version string, option int, related_version string, changed boolean, risk double"
    options = spark.createDataFrame(data, shape).mapInArrow(lambda batches: batches, shape)
    requests = spark.createDataFrame([(1, "3.11", "t", "2.0"), (2, "3.11", "t", "1.0")], "request_id int, python_version string, target_package string, requested_version string")
    env = spark.createDataFrame([(q, "3.11", "t", "1.0") for q in (1, 2)], "env_id int, python_version string, package string, version string")
    best = adv.best_candidates(related, options, requests, env).select("request_id", "position", "target_version", "category")
    best.explain()
    assert "MapInArrow" not in capsys.readouterr().out
    assert sorted(map(tuple, best.collect())) == [
        (1, 1, "2.0", adv.CATEGORIES[0]), (1, 2, "1.0", adv.CATEGORIES[1]),
        (2, 1, "1.0", adv.CATEGORIES[0]), (2, 2, "2.0", adv.CATEGORIES[2]),
    ]


def test_ids_of_feature_frames_are_dealt_out_by_their_number(spark, monkeypatch, capsys):
    monkeypatch.setattr(ft, "ROWS_PER_TASK", 20, raising=False)
    ids = [None, None, "x", "x", *map(str, range(300))]
    frame = spark.createDataFrame([(i, "pass") for i in ids], "experiment_id string, outcome string")
    matrix = spark.createDataFrame([(i,) for i in [None, "y", "0", *map(str, range(299))]], "experiment_id string")
    audit = spark.createDataFrame([(True, True, 0)], "structural_valid boolean, complete boolean, failed long")
    problems = ft.validate_feature_frames(frame, matrix, audit, [frame.filter("experiment_id < '1'").select("experiment_id")])
    problems.explain()
    assert "hashpartitioning(experiment_id" in (plan := capsys.readouterr().out)
    assert {int(n) for n in re.findall(r"hashpartitioning\(experiment_id#\d+, (\d+)\)", plan)} == {31}
    assert rows(problems, "rule", "key") == sorted(
        [("row_extra", None), ("row_repeated", None), ("row_extra", "x"), ("row_repeated", "x"), ("row_extra", "299"),
         ("row_missing", None), ("row_missing", "y"), ("shared_with_blind_set", "0")], key=repr)


def test_tree_digest_against_a_plain_tree(spark):
    import hashlib

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    files = [(f"dir/file {i} é", i, sha(f"content {i}")) for i in range(300)]
    frame = spark.createDataFrame(files, "file string, bytes long, sha256 string")
    leaves, branches = {}, {}
    for name, _, digest in files:
        leaves.setdefault(sha(name)[:4], []).append(f"{digest}  {name}")
    for leaf, lines in leaves.items():
        branches.setdefault(leaf[:2], []).append(f"{leaf} {sha(chr(10).join(sorted(lines)))}")
    root = sha("\n".join(sorted(f"{b} {sha(chr(10).join(sorted(x)))}" for b, x in branches.items())))
    got = manifests.fileset_digest(frame.repartition(7)).first()
    assert (got.files, got.bytes, got.digest) == (300, sum(range(300)), root)
    assert manifests.fileset_digest(frame.limit(299)).first().digest != root
    empty = manifests.fileset_digest(frame.limit(0)).first()
    assert (empty.files, empty.digest) == (0, sha(""))


# Streaming ---------------------------------------------------------------


def events(spark, folder, name, data):
    df = spark.createDataFrame(data, "experiment_id string, outcome string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    return df.schema


def test_stream_resume_restarts_without_repeats(spark, folder):
    schema = events(spark, folder, "in", [("a", "pass", "2024-01-01 00:00:00"), ("b", "infrastructure_failure", "2024-01-01 00:01:00")])

    def step():
        stream = so.read_file_stream(spark, schema, f"{folder}/in")
        return so.stream_resume(stream, f"{folder}/out")

    assert rows(step(), "experiment_id") == [("a",)]
    events(spark, folder, "in", [("a", "pass", "2024-01-01 00:02:00"), ("b", "pass", "2024-01-01 00:03:00")])
    assert rows(step(), "experiment_id") == [("a",), ("b",)]
    assert rows(step(), "experiment_id") == [("a",), ("b",)]


def test_ttl_cache_matches_brute_force(spark):
    import random

    r = random.Random(1)
    data = [("hot" if r.random() < 0.4 else f"k{r.randrange(5)}", r.randrange(20_000)) for _ in range(1500)]
    df = spark.createDataFrame(data, "key string, s int").select("key", F.timestamp_seconds("s").alias("ts"))
    got = {(x["key"], x["s"]): (x["requests"], x["computed"]) for x in so.ttl_cache(df, 900).withColumn("s", F.unix_timestamp("ts")).collect()}
    for key in {k for k, _ in data}:
        times = sorted(s for k, s in data if k == key)
        start, want = None, {}
        for s in times:
            if start is None or s - start >= 900:
                start = s
                want[s] = True
            want.setdefault(s, False)
        for s, computed in want.items():
            assert got[(key, s)] == (times.count(s), computed)


def test_conversation_limits(spark):
    turns = spark.createDataFrame([("c", i, "user" if i % 2 == 0 else "bot", f"t{i}") for i in range(10)], "conv_id string, turn int, role string, text string")
    assert conv.message_limit(turns, 4).count() == 4 and conv.message_limit(turns, 5).count() == 4
    context = conv.recent_turns(turns, 2).first()["context"]
    assert context == "[user] t8\n[assistant] t9"


# Registry ----------------------------------------------------------------


def test_registry_is_consistent():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150


def test_entry_without_the_corpus_package(monkeypatch):
    """With the package or one of its libraries out of reach, all other queries stay registered."""
    import importlib
    import sys

    import __spark_entry__ as entry

    with monkeypatch.context() as m:
        for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("pinlattice.llm")]:
            m.delitem(sys.modules, name)
        m.setitem(sys.modules, "pinlattice.llm", None)
        importlib.reload(entry)
        left = entry.queries()
        assert len(left) > 150 and not [n for n in left if n == "pipeline" or re.match(r"op\d", n)]
    importlib.reload(entry)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_warnings_are_listed_once(spark):
    columns = "env_id long, left string, left_version string, right string, right_version string, python_version string, covered boolean, embedding_missing boolean, constraints_allow boolean, combined_probability double, predicted_failure boolean, risk_score double"
    data = [(1, "a", "1", "b", "2", "3.11", False, None, None, None, None, None)] * 2
    data += [(1, "a", "1", "c", "2", "3.11", True, True, True, None, None, 0.5), (2, "a", "1", "b", "2", "3.11", True, False, True, 0.2, False, 0.2)]
    pairs = spark.createDataFrame(data, columns)
    got = {r.env_id: r for r in adv.environment_risk(pairs).collect()}
    assert got[1].warnings == 3 and len(got[1].distinct_warnings) == 2 and got[2].distinct_warnings == []
    assert [(r.env_id, r.right, r.position) for r in adv.pair_risk_order(pairs).orderBy("env_id").collect()] == [(1, "c", 1), (2, "b", 1)]


def test_leakage_of_late_stages():
    for column in ("import_probability", "smoke_exit_code"):
        with pytest.raises(ContractError):
            ft.leakage_guard([column])


def test_null_keys_are_one_key_of_the_cache(spark):
    from pinlattice.streaming.observations import ttl_cache

    data = [(None, 0), (None, 10), (None, 200), ("a", 5), ("a", 20), ("b", 20)]
    frame = spark.createDataFrame([(k, s) for k, s in data], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    got = ttl_cache(frame, 100).collect()
    assert sorted(((r.key or "", r.computed) for r in got)) == [("", False), ("", True), ("", True), ("a", False), ("a", True), ("b", True)]


def test_texts_without_tokens_stay(spark):
    from pinlattice.operators.texts import embed_texts, hashing_encoder

    frame = spark.createDataFrame([(1, None), (2, " "), (3, "word " * 6000 + "last")], "k long, text string")
    got = {r.k: r for r in embed_texts(frame, ["k"], hashing_encoder(16)).collect()}
    assert got[1].embedding is None and got[2].violation == "text has no tokens"
    spread = embed_texts(frame.filter("k = 3"), ["k"], hashing_encoder(16), max_chunks=2).first()
    assert got[3].violation is None and got[3].embedding != spread.embedding


def test_uncataloged_experiments_do_not_vanish(spark):
    data = [("e1", "x", "1", "x", "1", "3.11"), ("e2", "x", "1", "y", "1", "3.11")]
    experiments = spark.createDataFrame(data, "experiment_id string, package_a string, version_a string, package_b string, version_b string, python_version string")
    small = spark.createDataFrame([("x", "1", "3.11")], "name string, version string, python_version string")
    good, problems = ft.join_catalog(experiments, small)
    assert [r.experiment_id for r in good.collect()] == ["e1"]
    assert [(r.rule, r.key) for r in problems.collect()] == [("release_b_not_in_catalog", "e2")]
    with pytest.raises(Exception, match="release not in catalog: e2"):
        ft.join_catalog(experiments, small, strict=True)[0].collect()
