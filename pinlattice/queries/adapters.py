"""Adapter views: the given tables seen as releases, families, observations, scores and turns.

Every view is one SQL text that both engines run. Views use only tables, never
each other, so any of them can be put in front of an oracle query.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

ADAPTERS = {
    "releases": """
select lower(replace(p_brand, '#', '-')) as package,
  concat(cast(p_size % 4 as varchar(9)), '.', cast(p_partkey % 10 as varchar(9)), '.', cast(p_partkey % 3 as varchar(9))) as version,
  p_partkey as release_id,
  date '2020-01-01' + cast(p_partkey % 2000 as int) as released,
  case when p_partkey % 11 = 0 then true else false end as yanked,
  case p_size % 3 when 0 then '>=3.9' when 1 then '>=3.9,<3.12' else null end as requires_python,
  concat(replace(lower(p_name), ' ', '_'), '-1.0-', case p_partkey % 4 when 0 then 'py3-none-any'
    when 1 then 'cp311-cp311-manylinux_2_17_x86_64' when 2 then 'cp38-abi3-manylinux_2_17_x86_64'
    else 'cp311-cp311-win_amd64' end, '.whl') as filename
from part
""",
    "families": """
select concat(lower(replace(b.brand, '#', '-')), '-next') as family,
  lower(replace(b.brand, '#', '-')) as package_a,
  lower(replace(c.brand, '#', '-')) as package_b,
  case b.n % 3 when 0 then 'development' when 1 then 'validation' else 'final_test' end as split
from (select distinct p_brand as brand, cast(substr(p_brand, 7) as int) as n from part) b
join (select distinct p_brand as brand, cast(substr(p_brand, 7) as int) as n from part) c on c.n = b.n + 1
""",
    "observations": """
select concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(9))) as experiment_id,
  concat('family-', cast(l_suppkey % 15 as varchar(9))) as family,
  concat('3.', cast(8 + l_partkey % 7 as varchar(9))) as python_version,
  case when l_linenumber = 7 and l_quantity > 45 then 'infrastructure_failure'
    when l_returnflag = 'R' then 'resolution_failure'
    when l_returnflag = 'N' and l_linestatus = 'O' then 'import_failure'
    when l_returnflag = 'N' and l_quantity < 10 then 'smoke_test_failure' else 'pass' end as outcome,
  l_quantity as duration_seconds, l_extendedprice as bytes, l_shipdate as ts,
  l_partkey as part_key, l_suppkey as supp_key, l_discount as discount, l_tax as tax
from lineitem
""",
    "matrix": """
select concat(cast(o_orderkey as varchar(20)), '-', cast(n.l as varchar(9))) as experiment_id
from orders cross join (select 1 as l union all select 2 union all select 3 union all select 8) n
""",
    "labelled": """
select d.doc_id, d.source as family, l.quality as actual, l.toxic as toxic,
  cast(d.n_chars % 97 as double) / 97.0 as score,
  case when l.quality = 0 then 'pass' when d.n_chars % 5 = 0 then 'import_failure'
    when d.n_chars % 5 = 1 then 'smoke_test_failure' else 'resolution_failure' end as outcome
from documents d join labels l on d.doc_id = l.doc_id
""",
    "notes": "select source as package, cast(doc_id as varchar(20)) as version, text from documents",
    "pins": """
select distinct l_orderkey as request_id, lower(replace(p_brand, '#', '-')) as package,
  concat(cast(p_size % 4 as varchar(9)), '.', cast(p_partkey % 10 as varchar(9)), '.0') as version
from lineitem join part on l_partkey = p_partkey
""",
}


class Tables:
    """Lazy access to the given tables and the adapter views of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in ADAPTERS:
            return self.sql(ADAPTERS[name])
        raise AttributeError(name)

    @cached_property
    def _frames(self) -> dict[str, DataFrame]:
        return {}

    def sql(self, text: str) -> DataFrame:
        """Run shared SQL with the base tables bound to this folder."""
        used = {t: getattr(self, t) for t in TABLES if _mentions(text, t)}
        for name in used:
            text = _bind(text, name)
        return self.spark.sql(text, **used)


def _mentions(text: str, table: str) -> bool:
    return _bind(text, table) != text


def _bind(text: str, table: str) -> str:
    import re

    return re.sub(rf"(\b(?:from|join)\s+){table}\b", rf"\1{{{table}}}", text)
