import random
from datetime import datetime, timedelta

from alembiq.llm import golden as G

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, salt string, salts string, fresh string, n_records string, cluster_id string"
FIELDS = ("cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", "balance", "name_from", "email_from", "segment_from", "balance_from", "address_from")
FAR = datetime(1, 1, 1)


def table(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA)


def brute(rows):
    """One record a cluster, from the rules as they are written, by sorting."""
    clusters = {}
    for cid, mid, source, at, name, email, city, nation, segment, balance in rows:
        blank = lambda v: None if v is None or not v.strip(" \t\n\x0b\x0c\r") else v
        trust = {"store": 4, "crm": 3, "partner": 2, "web": 1}.get(source, 0)
        finite = balance is not None and balance == balance and abs(balance) != float("inf")
        clusters.setdefault(mid if mid is not None else cid, []).append(dict(id=cid, at=at, trust=trust, name=blank(name), email=blank(email), city=blank(city), nation_id=nation, segment=blank(segment), balance=balance if finite else None))
    out = {}
    for c, members in clusters.items():
        latest = max((r["at"] for r in members if r["at"]), default=None)
        for r in members:
            r["stale"] = r["at"] is None or latest - r["at"] > timedelta(hours=240)
        recent = lambda r: (r["at"] is None, -((r["at"] or FAR) - FAR) // timedelta(microseconds=1), -r["trust"], r["id"] is None, r["id"] or 0)
        trusted = lambda r: (r["stale"], -r["trust"], *recent(r))

        def first(field, order):
            have = sorted((r for r in members if r[field] is not None), key=lambda r: (*order(r), r[field]))  # noqa: B023
            return (have[0][field], have[0]["id"]) if have else (None, None)

        segment, segment_from = first("segment", recent)
        email, email_from = first("email", trusted)
        name, name_from = first("name", lambda r: (-len(r["name"]), *trusted(r)))
        balance, balance_from = first("balance", lambda r: (segment is None or r["segment"] != segment, *recent(r)))  # noqa: B023
        filled = lambda r: (r["city"] is not None) + (r["nation_id"] is not None)
        a = min(members, key=lambda r: (-filled(r), *recent(r), r["city"] is not None, r["city"] or "", r["nation_id"] is not None, r["nation_id"] or 0))
        out[c] = (c, len(members), sum(r["stale"] for r in members), name, email, segment, a["city"], a["nation_id"], balance, name_from, email_from, segment_from, balance_from, a["id"] if filled(a) else None)
    return out


def result(spark, rows):
    return {r["cluster_id"]: tuple(r[f] for f in FIELDS) for r in G.golden_records(table(spark, rows)).collect()}


def made(n, seed, clusters):
    r = random.Random(seed)
    at = lambda: None if r.random() < 0.1 else datetime(2024, 3, r.randint(1, 25), r.choice((0, 12)))
    some = lambda *v: r.choice([*v, None, "", " \t"])
    return [
        (None if r.random() < 0.05 else r.randint(0, n // 2), r.choice([None, *range(clusters)]), r.choice(["store", "crm", "partner", "web", "other", None]), at(),
         some("Ann", "Bö", "B\U0001f600", "  Ann ", "Annabel"), some("a@x", "b@x"), some("Rom", "Ulm"), r.choice([None, 1, 2]), some("retail", "public"), r.choice([None, 1.5, -2.0, 7.25, float("nan")]))
        for _ in range(n)
    ]


def test_equals_brute_force_with_ties_nulls_and_repeated_ids(spark):
    rows = made(600, 1, 40)
    rows += rows[:50]
    assert result(spark, rows) == brute(rows)


def test_a_cluster_with_most_rows_is_dealt_over_tasks(spark):
    rows = [(i, 7, *r[2:]) for i, r in enumerate(made(3000, 2, 1))] + made(100, 3, 10)
    clients = table(spark, rows)
    sizes = G.prepared(clients).groupBy("cluster_id").count().withColumnRenamed("count", "n_records")
    dealt = G._dealt(G.prepared(clients), sizes).where("cluster_id = 7").groupBy("salt").count().collect()
    assert len(dealt) > 4 and max(r["count"] for r in dealt) < 1000
    assert result(spark, rows) == brute(rows)


def test_to_the_microsecond(spark):
    new = datetime(2024, 3, 20)
    rows = [(i, 1, "web", new - timedelta(hours=240, microseconds=m), *[None] * 6) for i, m in enumerate((0, 1))] + [(9, 1, "web", new, *[None] * 6)]
    assert result(spark, rows)[1][:3] == (1, 3, 1)


def test_the_chosen_segment_drives_the_balance(spark):
    day = lambda d: datetime(2024, 3, d)
    row = lambda i, d, segment, balance: (i, 1, "web", day(d), None, None, None, None, segment, balance)
    rows = [row(1, 9, "retail", None), row(2, 8, None, 5.0), row(3, 2, "retail", 7.0), row(4, 3, "public", 6.0)]
    got = result(spark, rows)[1]
    assert got[5] == "retail" and got[8] == 7.0 and got[12] == 3
    assert result(spark, [row(2, 8, None, 5.0), row(3, 9, None, 6.0)])[1][8] == 6.0


def test_an_address_may_be_half_or_wholly_null(spark):
    row = lambda i, d, city, nation: (i, 1, "web", datetime(2024, 3, d), None, None, city, nation, None, None)
    assert result(spark, [row(1, 1, "Rom", None), row(2, 9, None, 3), row(3, 20, " ", None)])[1][6:8] == (None, 3)
    assert result(spark, [row(1, 1, None, None), row(2, 9, "", None)])[1][-1] is None


def test_empty_table(spark):
    assert result(spark, []) == {}


def test_nothing_that_grows_is_broadcast_by_a_join(spark):
    df = G.golden_records(table(spark, made(200, 4, 30)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" not in plan
