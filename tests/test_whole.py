"""Queries against plain versions that read every row and whole values."""

import math
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from packetloom.functions import scalars
from packetloom.plans import catalog

from .conftest import DATA
from .test_queries import key, plain


def entropy(data: bytes) -> float:
    return abs(sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values())) if data else 0.0


def test_entropy_of_whole_texts(spark, tmp_path):
    rng = random.Random(1)
    tail = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789 äß€") for _ in range(20_000))
    texts = [("plain start " * 50) + tail, ("plain start " * 50) + "a" * 50_000, "a" * 600 + "b" * 600, "", None, "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.entropy for r in catalog.QUERIES["fn01_byte_entropy"](spark, str(tmp_path)).collect()}
    assert got == {i: pytest.approx(entropy((t or "").encode()), abs=2e-6) for i, t in enumerate(texts)}


def test_entropy_of_any_bytes(spark):
    rng = random.Random(2)
    values = [bytes(rng.choices(range(256), k=n)) for n in (1, 7, 300, 9_000)] + [bytes(range(256)) * 3, b"\0" * 9]
    rows = spark.createDataFrame([(bytearray(v),) for v in values], "v binary").select("v", scalars.byte_entropy(F.col("v")).alias("h")).collect()
    assert [r.h for r in rows] == [pytest.approx(entropy(bytes(r.v)), abs=1e-9) for r in rows]


def test_audit_chains_of_all_rows(spark, duck):
    from packetloom.sources.adapters import over_packets

    got = {tuple(r) for r in catalog.QUERIES["gov09_verify_chain"](spark, DATA).select("chain", "first_bad_id").collect()}
    bad = "select seq, src, seq % 500 = 3 as own, coalesce(lag(seq % 500 = 250) over (partition by src order by seq), false) as link from packets"
    assert got == set(duck.execute(over_packets(f"select src, min(seq) from ({bad}) where seq % 500 <> 250 and (own or link) group by src")).fetchall())


def test_audit_chain_shows_both_kinds_of_damage(spark):
    from packetloom.operators import governance

    rows = [(i, f"host-{i % 2}", f"u{i}", "view", None if i == 4 else "r", "ip", i * 9) for i in range(10)]
    frame = spark.createDataFrame(rows, "id long, chain string, user_id string, action string, resource string, ip_address string, timestamp_epoch long")
    chained = governance.chain_entries(frame, "chain")
    assert governance.verify_chain(chained, by="chain").count() == 0
    changed = chained.withColumn("action", F.when(F.col("id") == 5, "other").otherwise(F.col("action")))
    assert [r.id for r in governance.verify_chain(changed, by="chain").collect()] == [5]
    assert [r.id for r in governance.verify_chain(chained.where("id <> 4"), by="chain").collect()] == [6]
    assert [r.id for r in governance.verify_chain(chained.where("id <> 0"), by="chain").collect()] == [2]


@pytest.fixture(scope="module")
def moved(spark, tmp_path_factory):
    """The smallest tables with event ids from 20000 on and 100 suppliers, and a connection to them."""
    import duckdb

    top = tmp_path_factory.mktemp("moved")
    for path in Path(DATA).glob("*.parquet"):
        if path.stem not in ("events", "supplier"):
            (top / path.name).symlink_to(path)
    (top / "supplier.parquet").symlink_to(Path(DATA).parent / "sf0.01" / "supplier.parquet")
    spark.read.parquet(f"{DATA}/events.parquet").withColumn("event_id", F.col("event_id") + 20_000).write.parquet(f"{top}/events.parquet")
    con = duckdb.connect()
    for path in top.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}/*.parquet')" if path.is_dir() and not path.is_symlink() else f"create view {path.stem} as select * from read_parquet('{path}')")
    return str(top), con


# What the registered SQL cuts, and the same without the cut.
RULES = (("select p_partkey as rule_id", "select min(p_partkey) as rule_id"), ("from part where p_partkey < 20", "from part group by all"))
ALLOWED = (("select distinct protocol, src from ops where seq < 300 and protocol <> 'BACNET'", "select protocol, src from ops where protocol <> 'BACNET' group by all having count(*) filter (op_type = 'read') * 5 >= count(*)"),)
UNCUT = {
    "det22_rule_batch": (("(select * from packets where seq >= 9000) e", "packets e"), *RULES),
    "det02_rule_cooldown": RULES,
    "flt17_rule_match": RULES,
    "udf03_table_function": ((" where seq < 2000", ""),),
    "gov10_audit_page": ((" where seq < 3000", ""),),
    "jn03_ids_rules": (("select p_partkey as sid", "select min(p_partkey) as sid"), ("from part where p_partkey < 30", "from part group by all")),
    "jn12_asset_impact": ((" where s_suppkey < 40", ""), ("(select * from assets where ip is not null) a on", "(select ip, unnest(min(struct_pack(hostname := hostname, tier := tier, department := department))) from assets where ip is not null group by ip) a on")),
    "jn16_enriched_row": (("(select * from supplier where s_suppkey < 40) on s_suppkey = k", "supplier on s_suppkey = k and k < 60"),),
    "ot01_whitelist": ALLOWED,
    "ot05_first_anomaly": ALLOWED,
    "ot05_breakdown": ALLOWED,
    "prj13_http_meaning": ((" where k < 20", ""), ("case when k * 4 < 100 then 'succeeded' end", "case when k < 25 then 'succeeded' when k < 50 then 'was redirected' when k < 75 then 'was refused' else 'failed at the server' end")),
    "fp03_ja4": ((" where not list_contains(extensions[3:6], 0) and not list_contains(extensions[3:6], 16)", ""), ("list_transform(extensions[3:6], ", "list_transform(list_filter(extensions[3:6], lambda x: x not in (0, 16)), ")),
    "srv25_case_story": ((" where k < 10", ""),),
    "srv22_upsert": ((" where s_suppkey < 60 and s_suppkey not between 40 and 80", " where s_suppkey not in (select c_custkey from customer)"), (" and s_suppkey < 60 where c_custkey between 40 and 80", "")),
    "srv21_status_changes": ((" where l_orderkey % 5 = 0", ""),),
    "jn19_snapshot_diff": (("seq % 7 < 2", "us < 1705363200000000"), ("seq % 7 >= 5", "us >= 1705363200000000")),
}


@pytest.mark.parametrize("name", UNCUT)
def test_query_equals_sql_without_its_cut(spark, moved, name):
    top, con = moved
    sql = catalog.ORACLES[name]
    for cut, whole in UNCUT[name]:
        assert cut in sql or whole in sql
        sql = sql.replace(cut, whole)
    frame = catalog.QUERIES[name](spark, top)
    cursor = con.execute(sql)
    order = [[c[0] for c in cursor.description].index(c) for c in frame.columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=key)
    assert sorted((tuple(plain(v) for v in r) for r in frame.collect()), key=key) == want
    assert want
