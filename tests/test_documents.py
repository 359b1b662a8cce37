import json
import random

import pytest
from pyspark.sql import functions as F

from pinlattice.sources.documents import read_sections, write_document
from pinlattice.sources.readers import read_manifest


@pytest.fixture
def small_splits(spark):
    names = [
        "spark.sql.files.maxPartitionBytes",
        "spark.sql.files.openCostInBytes",
        "spark.sql.adaptive.coalescePartitions.enabled",
    ]
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ["97", "1", "false"]):
        spark.conf.set(name, value)
    yield spark
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def save(folder, name, text):
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
    return path


def by_section(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["section"], r["position"])):
        out.setdefault(r["section"], []).append((r["position"], r["name"], json.loads(r["value"])))
    return out


def odd_value(rng, depth=0):
    texts = ['}{', '"', '\\', 'a}]"{[', '\\"}', 'ß}', '', 'x' * 150, '\n\t', '},{"k":{']
    kinds = ["text", "number", "flag", "list", "object"] if depth < 3 else ["text", "number", "flag"]
    kind = rng.choice(kinds)
    if kind == "text":
        return rng.choice(texts)
    if kind == "number":
        return rng.randrange(-5, 1000)
    if kind == "flag":
        return rng.choice([True, False, None])
    n = rng.randrange(3)
    if kind == "list":
        return [odd_value(rng, depth + 1) for _ in range(n)]
    return {rng.choice(texts) + str(i): odd_value(rng, depth + 1) for i in range(n)}


@pytest.mark.parametrize("seed", range(2))
def test_random_documents_over_many_splits(small_splits, folder, seed):
    rng = random.Random(seed)
    record = lambda: {f"k{i}": odd_value(rng) for i in range(rng.randrange(4))}
    document = {
        "before": ["a}", [["{"]], 3],
        "named": {f'n{i}"}}{{': record() for i in range(rng.randrange(1, 30))},
        "none": {},
        "listed": [record() for _ in range(rng.randrange(1, 30))],
        "empty": [],
        "after": "}]",
    }
    text = json.dumps(document, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
    path = save(folder, "d.json", text + rng.choice(["", "\n", " \n\n"]))
    df = read_sections(small_splits, path)
    assert small_splits.read.text(path, lineSep="}").rdd.getNumPartitions() > 1
    got = by_section(df)
    assert got["named"] == [(i, k, v) for i, (k, v) in enumerate(document["named"].items())]
    assert got["listed"] == [(i, None, v) for i, v in enumerate(document["listed"])]
    assert set(got) == {"named", "listed"}
    members = df.first()["members"]
    assert json.loads(members["before"]) == document["before"] and members["after"] == "}]"
    assert set(members) == {"before", "none", "empty", "after"}


def test_written_document_is_one_document_over_many_files(small_splits, folder):
    rows = small_splits.range(200).select(
        F.concat(F.lit('p"}'), "id").alias("name"), F.to_json(F.struct("id", F.lit("}\\\"").alias("t"))).alias("value")
    )
    path = write_document(
        small_splits, f"{folder}/w", {"packages": (rows, ["name"]), "families": (rows.select("value"), ["value"])}, {"n": "3"}
    )
    files = sorted(small_splits.read.text(path).select("_metadata.file_name").distinct().toPandas()["file_name"])
    assert len(files) > 1
    whole = json.loads("".join(open(f"{path}/{f}", encoding="utf-8").read() for f in files))
    names = sorted((f'p"}}{i}' for i in range(200)))
    assert list(whole["packages"]) == names and len(whole["families"]) == 200 and whole["n"] == 3
    got = by_section(read_sections(small_splits, path))
    assert [(n, v) for _, n, v in got["packages"]] == list(whole["packages"].items())
    assert [v for _, _, v in got["families"]] == whole["families"]


def test_damaged_documents_fail_and_empty_ones_give_no_row(spark, folder):
    good = '{"a": {"x": {"n": 1}, "y": {"n": 2}}}'
    for i, text in enumerate([good[:-1], good[:-2], good[:-1] + "\n", good[:-9], good.replace('"y"', '"y')]):
        with pytest.raises(Exception, match="not a whole JSON document"):
            read_sections(spark, save(folder, f"cut{i}.json", text)).collect()
    for i, text in enumerate(['{"a": {"x": {"n": 1}, "k": 5, "y": {}}}', '{"a": [3, {"n": 1}]}']):
        with pytest.raises(Exception, match="more than objects"):
            read_sections(spark, save(folder, f"mixed{i}.json", text)).collect()
    for i, text in enumerate(["{}", '{"a": [], "b": 2}']):
        assert read_sections(spark, save(folder, f"none{i}.json", text)).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_sections(spark, f"{folder}/absent.json")


def test_manifest_keeps_order_and_rejects_malformed_fields(small_splits, folder):
    items = [{"family": f"f{i % 3}", "package_a": f"a=={i}", "package_b": "b==1", "python": "3.11"} for i in range(60)]
    path = save(folder, "m.json", json.dumps({"experiments": items}))
    got = {r["position"]: r["package_a"] for r in read_manifest(small_splits, path).collect()}
    assert got == {i: f"a=={i}" for i in range(60)}
    items[7]["python"] = 5
    items[9]["family"] = {"not": "text"}
    bad = save(folder, "bad.json", json.dumps({"experiments": items[:1] + ["x"] + items[1:]}))
    with pytest.raises(Exception):
        read_manifest(small_splits, bad).collect()
