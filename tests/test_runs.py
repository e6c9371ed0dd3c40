"""Duplicates, clusters, selection, audit, weekly review, streams; brute force on small random inputs."""

import datetime as dt
import itertools
import json
import random

import pandas as pd
from pyspark.sql import functions as F

from siftwire.operators import audit, candidates, dedupe, matching, scan, weekly
from siftwire.plans import registry as queries
from siftwire.streaming import jobs

WORDS = ["fed", "rate", "cut", "chip", "export", "rule", "tax", "bank", "oil", "deal", "vote", "law"]


def titles(rng, n):
    return [" ".join(rng.sample(WORDS, rng.randint(1, 5))) for _ in range(n)]


def items(spark, rows):
    return spark.createDataFrame(rows, "run_id long, ord long, id string, title string, url string, source string, credibility double, published_at timestamp, event_type string")


def row(i, title, url=None, cred=70.0, run=0, kind="other", source="s"):
    return (run, i, f"i{i}", title, url or f"https://e.com/{run}/{i}", source, cred, dt.datetime(2026, 7, 1), kind)


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0


def test_dedupe_keeps_the_better_and_lists_the_other(spark):
    df = items(spark, [row(0, "Fed cuts rate again", "https://e.com/x?utm_source=a"), row(1, "Something else entirely", "https://e.com/x", 90.0), row(2, "Unrelated tax law vote", cred=50.0), row(3, "", "https://e.com/y"), row(4, "", "https://e.com/z")])
    out = {r.id: r for r in dedupe.dedupe_items(df).collect()}
    assert set(out) == {"i1", "i2", "i3", "i4"} and [d.id for d in out["i1"].duplicates] == ["i0"] and out["i1"].duplicate_count == 1
    assert {r.id: r.duplicate_count for r in dedupe.dedupe_items(df, arrays=False).collect()} == {k: r.duplicate_count for k, r in out.items()}
    assert [(r.id, r.best_ord) for r in dedupe.duplicate_rows(df).collect()] == [("i0", out["i1"].ord)]


def test_pairs_components_and_first_fit_equal_brute_force(spark):
    rng = random.Random(1)
    for t in (0.5,):
        ts = titles(rng, 60)
        df = items(spark, [row(i, x, run=i % 2) for i, x in enumerate(ts)])
        sets = [set(x.split()) for x in ts]
        firsts = {}
        for i, s in enumerate(sets):
            firsts.setdefault((i % 2, frozenset(s)), i)
        reps = sorted(firsts.values())
        want = {(a, b) for a, b in itertools.combinations(reps, 2) if a % 2 == b % 2 and jac(sets[a], sets[b]) >= t}
        assert {(r.a, r.b) for r in dedupe.title_pairs(df, t).collect()} == want
        root = list(range(60))
        for _ in range(60):
            for a, b in itertools.product(range(60), repeat=2):
                if a % 2 == b % 2 and jac(sets[a], sets[b]) >= t:
                    root[a] = root[b] = min(root[a], root[b])
        assert {r.ord: r.component for r in dedupe.duplicate_components(df, t).collect()} == dict(enumerate(root))
        groups = {}
        for run in (0, 1):
            made: list[list[int]] = []
            for i in range(run, 60, 2):
                g = next((g for g in made if any(jac(sets[i], sets[j]) >= t for j in g)), None)
                if g is None:
                    made.append([i])
                else:
                    g.append(i)
            groups |= {i: g[0] for g in made for i in g}
        assert {r.ord: r.group for r in dedupe.duplicate_groups(df, t, "first_fit").collect()} == groups


def test_clusters_equal_leader_clustering(spark):
    rng = random.Random(2)
    ts, kinds = titles(rng, 70), [rng.choice(["a", "b"]) for _ in range(70)]
    df = items(spark, [row(i, x, kind=k) for i, (x, k) in enumerate(zip(ts, kinds, strict=True))])
    toks = [list(dict.fromkeys(w for w in x.split() if len(w) > 2))[:12] for x in ts]
    leaders, want = [], {}
    for i in range(70):
        def near(j, i=i):
            a, b = set(toks[i]), set(toks[j])
            return kinds[i] == kinds[j] and (jac(set(ts[i].split()), set(ts[j].split())) >= 0.42 or (a and b and len(a & b) / min(len(a), len(b)) >= 0.5))

        lead = next((j for j in leaders if near(j)), None)
        if lead is None:
            leaders.append(i)
            lead = i
        want[i] = lead
    got = {r.ord: r.event_cluster_key for r in dedupe.assign_event_clusters(df).collect()}
    keys = {}
    for i, lead in want.items():
        assert got[i] == got[lead]
        keys.setdefault(lead, got[lead])


def brute_select(rows, rules):
    left, taken, out = list(rows), [], {}
    src, cat, typ, clu = {}, {}, {}, {}
    while left:
        left.sort(key=lambda r: (-(r["candidate_value"] - 3 * src.get(r["k"], 0) - 2 * len(clu.get(r["event_cluster_key"], ()))), -r["published_at"].value))
        r = left.pop(0)
        c = clu.get(r["event_cluster_key"], set())
        if len(taken) >= rules.global_quota:
            why = "global-quota"
        elif src.get(r["k"], 0) >= r["quota"]:
            why = "source-quota"
        elif cat.get(r["candidate_category"], 0) >= rules.category_quota:
            why = "category-quota"
        elif r["event_type"] not in ("policy_change", "economic_data", "security_incident") and typ.get(r["event_type"], 0) >= rules.event_type_quota:
            why = "event-type-quota"
        elif r["k"] not in c and len(c) >= rules.cluster_quota:
            why = "event-cluster-quota"
        else:
            why = None
            taken.append(r)
            src[r["k"]] = src.get(r["k"], 0) + 1
            cat[r["candidate_category"]] = cat.get(r["candidate_category"], 0) + 1
            typ[r["event_type"]] = typ.get(r["event_type"], 0) + 1
            clu.setdefault(r["event_cluster_key"], set()).add(r["k"])
        out[r["ord"]] = why
    return out


def test_selection_obeys_quotas(spark):
    rng, rows, want, critical = random.Random(3), [], {}, ("policy_change", "economic_data", "security_incident")
    for run, n in enumerate((1, 40, 120, 300, 90)):
        few = run % 2
        mine = [dict(run_id=run, ord=i, candidate_value=rng.randint(60, 90) if few else rng.randint(60, 64), published_at=pd.Timestamp(2026, 7, 1) + pd.Timedelta(hours=rng.randint(0, 5)), candidate_category=rng.choice("abc" if few else "abcdefg"), event_type=rng.choice(["policy_change", "x", "y"]), event_cluster_key=rng.choice("pqrstuv"), k=rng.choice("ABCDEFGHIJKLMN"), quota=rng.choice([1, 3, 5])) for i in range(n)]
        for limits in (candidates.SelectionRules(), candidates.SelectionRules(global_quota=10, category_quota=4, cluster_quota=2)):
            want[run, limits.global_quota] = brute_select(mine, limits)
        rows += mine
    df = spark.createDataFrame([(r["run_id"], r["ord"], r["candidate_value"], r["published_at"].timestamp(), r["k"], r["candidate_category"], r["event_type"], r["event_cluster_key"], r["quota"]) for r in rows], "run_id long, ord long, value int, seconds double, k string, category string, kind string, cluster string, quota int").repartition(3)
    for limits, width in ((candidates.SelectionRules(), None), (candidates.SelectionRules(global_quota=10, category_quota=4, cluster_quota=2), 6)):
        got = {}
        for r in candidates.selection(df, limits, critical, width).collect():
            got.setdefault(r.run_id, {})[r.ord] = None if r.reason == "selected" else r.reason
        assert all(got[run] == w for (run, quota), w in want.items() if quota == limits.global_quota)
        assert all(sum(v is None for v in g.values()) <= limits.global_quota for g in got.values())
    assert candidates.selection(df.limit(0), limits, critical).count() == 0


def test_best_match_levels_equal_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(i % 2, i, str(i // 2 if i % 5 else i), " ".join(rng.sample(words[: rng.choice([8, 60])], rng.randint(1, 8)) + ["hot"] * (i % 3 > 0))) for i in range(240)] + [(0, 900, "x", ""), (0, 901, None, "w1 w2 hot"), (2, 902, "y", "w1 w2")]
    df = spark.createDataFrame(rows, "run_id long, ord long, id string, title string")
    recent = df.where("run_id < 2 and ord % 2 = ord % 4").select((F.lit(1) - F.col("run_id")).alias("run_id"), "id", "title").unionByName(df.where("run_id = 0 and ord % 7 = 0").select("run_id", "id", "title"))
    there = [(r.run_id, r.id, set(r.title.split())) for r in recent.collect()]
    want = {}
    for run, o, i, t in rows:
        mine, others = set(t.split()), [x for x in there if x[0] == run]
        best = max([len(mine & s) / len(mine | s) for _, j, s in others if j != i and (mine or s)], default=0.0)
        want[o] = max(0, int(20 * (1 - best) + 0.5)) if others else 16
    assert {r.ord: r.information_gain for r in candidates.information_gain(df, recent).collect()} == want


def test_best_match_of_long_titles_in_blocks_is_exact(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(90)]
    one, two = [[(run, i, str(i + k * run), rng.sample(words, rng.choice([1, 4, 25, 40]))) for run in (0, 1) for i in range(50)] for k in (0, 3)]
    mine = spark.createDataFrame(one, "run_id long, node long, id string, tokens array<string>")
    theirs = spark.createDataFrame([(r, i, t) for r, _, i, t in two], "run_id long, id string, tokens array<string>")
    want = {(r, n): max(jac(set(t), set(u)) for q, _, j, u in two if q == r and j != i) for r, n, i, t in one}
    got = {(r.run_id, r.node): r.best for r in matching.best_match(mine, theirs, ["run_id"], most=20).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_clusters_of_copies_need_no_pairs_of_copies(spark, monkeypatch):
    met = []
    leaders = dedupe.leaders
    monkeypatch.setattr(dedupe, "leaders", lambda rows, edges, keys: met.append(edges.count()) or leaders(rows, edges, keys))
    texts = ["alpha beta gamma delta", "gamma beta delta alpha", "alpha beta omega sigma", "of", ""]
    df = items(spark, [row(i, texts[i % 5], kind="a") for i in range(100)])
    got = {r.ord: r.event_cluster_key for r in dedupe.assign_event_clusters(df).collect()}
    assert met[0] <= 3 and len(got) == 100
    for i, k in got.items():
        assert k == got[0 if i % 5 < 3 else i % 5]


def test_low_thresholds_meet_in_blocks_not_on_tokens(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "block_join", None)
    df = items(spark, [row(i, t) for i, t in enumerate(["the of one two", "the of one six", "the of ten", "of"])])
    assert {(r.a, r.b) for r in dedupe.title_pairs(df, 0.42).collect()} == {(0, 1)}


def test_block_join_deals_hot_keys_over_tasks(spark):
    left = spark.createDataFrame([("hot" if i % 2 else f"k{i % 10}", i) for i in range(2000)], "w string, a long")
    right = spark.createDataFrame([("hot" if i % 3 else f"k{i % 10}", i) for i in range(900)], "w string, b long")
    got = matching.block_join(left, right, ["w"], most=50)
    want = left.join(right, "w")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty() and got.columns == want.columns


def runs(spark, *rows):
    kinds = "source string, generated_at timestamp, fetched_count long, passed_count long, duplicate_count long, high_value_count long, body_attempt_count long, body_success_count long, density_total double, density_count long, fetch_failed boolean, is_probe boolean, high_value_rate double, body_success_rate double"
    return spark.createDataFrame([(s, d, n, n, dup, high, 10, good, 0.0, 0, failed, probe, high / n if n else 0.0, good / 10) for s, d, n, dup, high, good, failed, probe in rows], kinds)


def test_policy_degrades_and_recovers(spark):
    day = lambda i: dt.datetime(2026, 6, 1) + dt.timedelta(days=i)
    low = [("low", day(i), 10, 0, 0, 9, False, False) for i in range(5)]
    few = [("few", day(i), 10, 0, 0, 9, False, False) for i in range(2)]
    fall = [("fall", day(i), 10, 0, 0, 1, False, False) for i in range(24)] + [("fall", day(24 + i), 10, 0, 5, 9, False, True) for i in range(3)]
    got = {}
    for r in audit.source_policy(runs(spark, *low, *few, *fall)).orderBy("generated_at").collect():
        got.setdefault(r.source, []).append(r.status)
    assert got["low"] == ["active"] * 4 + ["reduced"] and got["few"] == ["active"] * 2
    assert got["fall"][:5] == ["active"] * 4 + ["reduced"] and "limited" in got["fall"] and "paused" in got["fall"] and got["fall"][-1] == "limited" and got["fall"][-2] == "paused"
    limits = audit.policy_limits(spark.createDataFrame([(s,) for s in ("active", "reduced", "limited", "paused")], "status string")).collect()
    assert [(r.metadata_limit, r.body_fetch_quota, r.minimum_fetch_interval_hours) for r in limits] == [(30, 3, 6), (15, 2, 12), (5, 1, 24), (5, 1, 168)]


def fetches(spark, *rows):
    return spark.createDataFrame([("s", dt.datetime(2026, 7, 1, i), ok, n) for i, (ok, n) in enumerate(rows)], "source string, fetched_at timestamp, ok boolean, item_count long")


def test_health_streaks_and_grace(spark):
    df = fetches(spark, (True, 3), (False, 0), (False, 0), (False, 0), (True, 0), (False, 0))
    plain = audit.source_health(df).orderBy("fetched_at").collect()
    assert [r.status for r in plain] == ["healthy", "failed", "failed", "failed", "empty", "failed"] and [r.failure_count for r in plain] == [0, 1, 2, 3, 0, 1] and plain[5].last_success_at == dt.datetime(2026, 7, 1, 0)
    assert [r.status for r in audit.source_health(df, 2).orderBy("fetched_at").collect()] == ["healthy", "healthy", "healthy", "failed", "empty", "empty"]


def test_fallback_uses_the_last_good_items(spark):
    got = audit.effective_records(fetches(spark, (True, 3), (False, 0), (True, 0), (False, 0))).orderBy("fetched_at").collect()
    assert [(r.effective_count, r.stale) for r in got] == [(3, False), (3, True), (0, False), (3, True)]


def test_sessions_join_at_exactly_the_gap(spark):
    at = lambda m: dt.datetime(2026, 7, 1) + dt.timedelta(minutes=m)
    df = spark.createDataFrame([(1, "x", "a", at(0)), (2, "x", "b", at(30)), (3, "x", "a", at(60)), (4, "x", "a", at(91))], "attempt_id long, stream string, source string, fetched_at timestamp")
    assert sorted((r.session, r.source, r.attempt_id) for r in audit.fetch_sessions(df).collect()) == [(1, "a", 3), (1, "b", 2), (2, "a", 4)]


def event(i, theme, day, **k):
    return (i, k.get("id", f"e{i}"), theme, f"title {i}", "summary", "tech", "other", float(k.get("score", 50)), dt.datetime(2026, 7, day), k.get("url", f"https://s/{i}"), k.get("conflict", []))


def test_weekly(spark):
    rows = [event(1, "a", 6), event(2, "a", 7), event(3, "a", 8), event(4, "b", 9), event(4, "b", 10, id="e4"), event(5, "a", 1), event(6, "c", 12, url=""), event(7, "d", 7, conflict=["x"])]
    df = spark.createDataFrame(rows, "ord long, event_id string, theme_key string, title string, summary string, category string, event_type string, importance_score double, archived_at timestamp, primary_url string, conflicting_evidence array<string>")
    w = weekly.weekly_windows(df, ["2026-07-13"])
    assert sorted((r.event_id, r.window) for r in w.collect()) == [("e1", "current"), ("e2", "current"), ("e3", "current"), ("e4", "current"), ("e5", "previous"), ("e6", "current"), ("e7", "current")]
    prior = spark.createDataFrame([("a", "j-a", 2, "summary"), ("d", "j-d", 1, "other"), ("z", "j-z", 1, "gone")], "theme_key string, judgment_id string, judgment_version int, conclusion string")
    t = {r.theme: r for r in weekly.weekly_themes(w, prior).collect()}
    assert (t["a"].signal, t["a"].event_count, t["a"].previous_count, t["a"].judgment_id, t["a"].judgment_version) == ("strong", 3, 1, "j-a", 2) and t["c"].signal == "weak" and t["d"].judgment_version == 2 and t["b"].judgment_id.startswith("judgment-")
    v = {r.theme: (r.judgment_id, r.outcome) for r in weekly.judgment_validation(weekly.weekly_themes(w, prior), prior).collect()}
    assert v["a"] == ("j-a", "verified") and v["d"] == ("j-d", "falsified") and v["z"] == ("j-z", "pending") and v["b"][1] == "pending"
    src = spark.createDataFrame([("i1", "N1", True), ("i2", "N2", False)], "source_id string, name string, enabled boolean")
    ev = spark.createDataFrame([(1, "i1", None), (2, None, "N1"), (3, "i2", "N2"), (4, None, None), (5, "x", "N1")], "n int, primary_id string, primary_name string")
    assert sorted(r.n for r in weekly.enabled_only(ev, src).collect()) == [1, 2, 4, 5]


def test_stream_items_dedupe_and_policy(spark, tmp_path):
    rec = {"source_id": "s", "source_name": "S", "fetched_at": "2026-07-10T00:00:00.000Z", "ok": True, "items": [{"title": "a", "link": "https://e.com/1?utm_source=x", "pub_date": "2026-07-09T10:00:00Z"}, {"title": "b", "link": "https://e.com/1", "pub_date": "2026-07-09T11:00:00Z"}, {"title": "old", "link": "https://e.com/2", "pub_date": "2026-07-01T00:00:00Z"}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(rec))
    items_ = jobs.stream_items(jobs.stream_records(spark, str(tmp_path / "in")))
    jobs.run_available(jobs.stream_dedupe(items_).select("title", "url"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0].url == "https://e.com/1"
    day = lambda i: dt.datetime(2026, 6, 1) + dt.timedelta(days=i)
    m = audit.rolling_source_metrics(runs(spark, *[("low", day(i), 10, 0, 0, 9, False, False) for i in range(6)])).select("source", "generated_at", F.to_json(F.struct("d14", "d30", "p14", "five_failed", "probes_good"), {"ignoreNullFields": "false"}).alias("m"))
    m = m.unionByName(m.limit(1).withColumn("source", F.lit("z")).withColumn("generated_at", F.lit(day(90))))  # the watermark passes all before it
    m.write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(m.schema).parquet(str(tmp_path / "m"))
    jobs.run_available(jobs.stream_policy(stream), str(tmp_path / "p"), str(tmp_path / "pck"))
    batch = audit.source_policy(runs(spark, *[("low", day(i), 10, 0, 0, 9, False, False) for i in range(6)]))
    order = lambda df: [(r.generated_at, r.status, r.reason) for r in df.orderBy("generated_at").collect()]
    assert order(spark.read.parquet(str(tmp_path / "p"))) == order(batch) and order(batch)[-1][1] == "reduced"


def test_every_query_with_sql_is_registered():
    assert set(queries.SQL) <= set(queries.QUERIES) and len(queries.QUERIES) >= 60


def shuffled_files(spark, rows, kinds, path, jitter=12, each=12):
    """Rows in files that do not follow their time, and a last row far ahead that lets the watermark pass all others."""
    rng = random.Random(5)
    order = sorted(range(len(rows)), key=lambda i: i + rng.uniform(0, jitter))
    for k in range(0, len(rows), each):
        spark.createDataFrame([rows[i] for i in order[k : k + each]], kinds).coalesce(1).write.mode("append").parquet(path)
    return spark.createDataFrame(rows, kinds)


def test_stream_health_equals_the_batch_in_any_order(spark, tmp_path):
    rng, at = random.Random(4), dt.datetime(2026, 7, 1)
    rows = [(i, f"s{i % 3}", at + dt.timedelta(minutes=i - i % 2), rng.random() < 0.5, rng.choice([0, 0, 3, None])) for i in range(60)]
    kinds = "attempt_id long, source string, fetched_at timestamp, ok boolean, item_count int"
    df = shuffled_files(spark, rows, kinds, str(tmp_path / "in"))
    stream = lambda: jobs.stream_health(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 2)
    jobs.run_available(stream(), str(tmp_path / "out"), str(tmp_path / "ck"))
    cols = ["source", "fetched_at", "status", "failure_count", "last_success_at"]
    assert spark.read.parquet(str(tmp_path / "out")).count() < len(rows)  # the last ones wait
    for k, day in enumerate((3, 60)):
        spark.createDataFrame([(100 + k, "far", at + dt.timedelta(days=day), True, 1)], kinds).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.run_available(stream(), str(tmp_path / "out"), str(tmp_path / "ck"))
        held = spark.read.format("statestore").load(str(tmp_path / "ck")).count()
        assert held == (4 if day == 3 else 1)  # sources without results for 35 days are forgotten
    want = audit.source_health(df, 2).select(*cols)
    got = spark.read.parquet(str(tmp_path / "out")).where("source <> 'far'").select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stream_sessions_equal_the_batch_in_any_order(spark, tmp_path):
    rng, at, minute, rows = random.Random(6), dt.datetime(2026, 7, 1), 0, []
    for i in range(60):
        minute += rng.choice([0, 1, 5, 10, 30, 31])
        rows.append((i, rng.choice("pq"), rng.choice("abc"), at + dt.timedelta(minutes=minute)))
    kinds = "attempt_id long, stream string, source string, fetched_at timestamp"
    df = shuffled_files(spark, rows, kinds, str(tmp_path / "in"), jitter=4)
    spark.createDataFrame([(99, "far", "a", at + dt.timedelta(days=60))], kinds).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.stream_sessions(source, 30, "3 hours"), str(tmp_path / "out"), str(tmp_path / "ck"))
    cols = ["stream", "session_start", "source", "attempt_id", "fetched_at"]
    want, got = audit.fetch_sessions(df, 30).select(*cols), spark.read.parquet(str(tmp_path / "out")).select(*cols)
    assert want.count() > 12 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_clusters_of_a_long_chain(spark):
    """Each title is like the next only, so leaders settle one after the other: far more of them than there are rounds."""
    n = 60
    df = items(spark, [row(i, f"a{i:02} a{i + 1:02} a{i + 2:02}") for i in range(n)])
    out = {r.ord: r.event_cluster_key for r in dedupe.assign_event_clusters(df).collect()}
    sets = [{f"a{i:02}", f"a{i + 1:02}", f"a{i + 2:02}"} for i in range(n)]
    leads: list[int] = []
    leader = []
    for i in range(n):
        near = [j for j in leads if jac(sets[i], sets[j]) >= 0.42 or len(sets[i] & sets[j]) / 3 >= 0.5]
        leader.append(min(near) if near else i)
        if not near:
            leads.append(i)
    assert len(set(leader)) > 12 and all(out[i] == out[leader[i]] for i in range(n)) and len(set(out.values())) == len(leads)


def test_selection_takes_quotas_of_sources(spark):
    df = items(spark, [row(i, f"Fed raises its policy rate number {i} by 25%", source="s", cred=90.0) for i in range(6)]).withColumn("source_id", F.lit("x")).withColumn("category", F.lit("finance")).withColumn("source_tier", F.lit("A")).withColumn("source_authority", F.lit("media")).withColumn("summary", F.lit("announced and approved, a summary that is long enough to count"))
    none = df.where("false").select("run_id", "id", "title")
    for quota in (1, 2):
        sources = spark.createDataFrame([("x", quota, "core")], "source_id string, body_fetch_quota int, source_policy_tier string")
        assert candidates.select_candidates(df, none, candidates.SelectionRules(candidate_threshold=1), sources).where("candidate_status = 'selected'").count() == quota


def test_scans_over_chunks_equal_windows_over_keys(spark):
    """A hot key lies in several chunks, and ties of time are broken by the attempt."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 5 else rng.choice(["a", "b", None]), dt.datetime(2026, 7, 1) + dt.timedelta(minutes=rng.randint(0, 900)), rng.random() < 0.6, rng.randint(0, 2), rng.choice("pq")) for i in range(3000)]
    df = spark.createDataFrame(rows, "attempt_id long, source string, fetched_at timestamp, ok boolean, item_count long, stream string").repartition(8)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        chunks = scan.chunked(df, ["source"], ["fetched_at", "attempt_id"])
        assert chunks.where("source = 'hot'").select(scan.CHUNK).distinct().count() >= 3
        health = {r.attempt_id: r for r in audit.source_health(df, 2).collect()}
        used = {r.attempt_id: r for r in audit.effective_records(df).collect()}
        sessions = {(r.stream, r.session, r.source): (r.attempt_id, r.session_start) for r in audit.fetch_sessions(df, 2).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert len(health) == len(used) == len(rows)
    state, want = {}, {}
    for i, s, at, ok, n, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        failures, success, before, kept = state.get(s, (0, None, None, None))
        own = "failed" if not ok else "healthy" if n else "empty"
        failures = failures + 1 if own == "failed" else 0
        success = at if own == "healthy" else success
        before = own if own != "failed" else before
        status = before if own == "failed" and failures <= 2 and before else own
        h, u = health[i], used[i]
        assert (h.status, h.failure_count, h.last_success_at) == (status, failures, success)
        back = not ok and kept is not None
        assert (u.stale, u.effective_count, u.effective_fetched_at) == (back, kept[1] if back else n if ok else 0, kept[0] if back else at)
        state[s] = (failures, success, before, (at, n) if ok and n else kept)
    last = {}
    for i, s, at, _, _, stream in sorted(rows, key=lambda r: (r[2], r[0])):
        t, k, start = last.get(stream, (None, 0, None))
        if t is None or at - t > dt.timedelta(minutes=2):
            k, start = k + 1, at
        last[stream] = (at, k, start)
        want[stream, k, s] = (i, start)
    assert sessions == want


def test_stars_join_a_long_path_and_a_hub(spark):
    """A path in random order, longer than any number of neighbour steps, beside a hub and a lone pair."""
    rng, n = random.Random(11), 5_000
    names = list(range(n))
    rng.shuffle(names)
    path = [(0, names[i], names[i + 1]) for i in range(n - 1)]
    hub = [(0, n + 5, n + 6 + i) for i in range(3000)] + [(1, 7, 8), (1, 7, 7)]
    got = dedupe.connected(spark.createDataFrame(path + hub, "run_id long, a long, b long"), ["run_id"]).collect()
    found = {(r.run_id, r.node): r.component for r in got}
    assert len(got) == len(found) == n + 3001 + 2
    assert all(c == (0 if node < n else n + 5) for (run, node), c in found.items() if run == 0) and found[1, 8] == found[1, 7] == 7


def test_leaders_of_chains_and_ladders_equal_the_order_bound_rule(spark):
    rng, n = random.Random(12), 1500
    edges = {(i, i + 1) for i in range(600)} | {(i, i + k) for i in range(700, 715) for k in (1, 2)} | {tuple(sorted(rng.sample(range(900, n), 2))) for _ in range(900)}
    before: dict = {}
    for a, b in edges:
        before.setdefault(b, []).append(a)
    want: dict = {}
    for i in range(n):
        want[i] = 2 if any(want[a] == 1 for a in before.get(i, ())) else 1
    rows = spark.createDataFrame([(0, i) for i in range(n)], "run_id long, ord long")
    got = dedupe.leaders(rows, spark.createDataFrame([(0, a, b) for a, b in edges], "run_id long, a long, b long"), ["run_id"])
    assert {r.ord: r.s for r in got.collect()} == want


def test_first_fit_with_copies_addresses_and_bridges_equals_brute_force(spark):
    """Copies of a title, shared addresses that move a later copy to an earlier group, and chains of like titles."""
    rng, t = random.Random(13), 0.5
    rows = [(i % 2, i, f"https://a/{rng.randint(0, 25)}" if rng.random() < 0.3 else "", " ".join(rng.choice([["a1", "b1", "c1"], ["a1", "b1", "d1"], ["b1", "d1", "e1"], rng.sample(WORDS, 3)])) if rng.random() < 0.95 else "") for i in range(160)]
    df = spark.createDataFrame(rows, "run_id long, ord long, url string, title string")
    groups = {}
    for run in (0, 1):
        made: list[list[tuple]] = []
        for _, i, url, title in [r for r in rows if r[0] == run]:
            s = set(title.split())
            g = next((g for g in made if any((url and url == u) or (s and x and jac(s, x) >= t) for _, u, x in g)), None)
            if g is None:
                made.append([(i, url, s)])
            else:
                g.append((i, url, s))
        groups |= {m[0]: g[0][0] for g in made for m in g}
    assert {r.ord: r.group for r in dedupe.duplicate_groups(df, t, "first_fit").collect()} == groups


def test_stream_similarity_gives_the_groups_of_one_batch(spark, tmp_path):
    rng = random.Random(17)
    rows = [(i, f"https://a/{rng.randint(0, 40)}" if rng.random() < 0.2 else "", " ".join(rng.sample(WORDS, rng.randint(2, 4))), dt.datetime(2026, 7, 1 + i // 30)) for i in range(90)]
    kinds = "ord long, url string, title string, published_at timestamp"
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_similar(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "ck"), 0.5)
    got = {r.ord: r.group for r in spark.read.parquet(str(tmp_path / "index")).collect()}
    want = dedupe.first_fit(spark.createDataFrame(rows, kinds).withColumn("run_id", F.lit(0)), 0.5)
    assert got == {r.ord: r.group for r in want.collect()} and len(set(got.values())) < 60


def test_like_pairs_meet_at_shared_tokens_and_equal_brute_force(spark):
    """Hot tokens in blocks, several tasks, rows that are not fresh; rows of tokens that no other has meet none, however many blocks they would be."""
    rng = random.Random(19)
    words = [f"w{k}" for k in range(40)]
    sets = [{*rng.sample(WORDS, rng.randint(0, 4)), *rng.sample(words, rng.randint(0, 5))} for _ in range(150)]
    sets = sorted({frozenset(s) for s in sets if s}, key=sorted)
    rng.shuffle(sets)
    fresh = [rng.random() < 0.7 for _ in sets]
    df = spark.createDataFrame([(i % 2, i, matching.SEP.join(sorted(s)), f) for i, (s, f) in enumerate(zip(sets, fresh, strict=True))], "k int, n long, t string, fresh boolean")
    for t, overlap in ((0.3, False), (0.5, True)):
        like = lambda a, b: len(a & b) / (min(len(a), len(b)) if overlap else len(a | b)) >= t  # noqa: E731, B023
        want = [(a % 2, a, b) for a, b in itertools.combinations(range(len(sets)), 2) if a % 2 == b % 2 and (fresh[a] or fresh[b]) and like(sets[a], sets[b])]
        got = matching.like_pairs(df, ["k"], t, overlap, most=6, dealt=100).collect()
        assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50
    lone = spark.createDataFrame([(0, i, matching.SEP.join(["the", *(f"{i}-{k}" for k in range(9))]), True) for i in range(400)], "k int, n long, t string, fresh boolean")
    assert matching.meetings(lone, ["k"], 0.42, most=10).count() == 0 and matching.like_pairs(lone, ["k"], 0.42, most=10).count() == 0


def test_first_fit_takes_as_many_rounds_for_many_copies_as_for_few(spark, monkeypatch):
    """Copies of a title behind one that led them to an earlier group, by way of many copies of another: till then the first copy's own group, a dead
    end, is the least they know."""
    count: list[int] = []
    stored = dedupe.stored
    monkeypatch.setattr(dedupe, "stored", lambda df: count.append(1) or stored(df))
    texts = ["aa bb cc dd", "cc dd ee ff", *["dd cc bb aa"] * 200, "bb cc dd ee", *["ff ee dd cc"] * 60, "zz yy xx"]
    df = items(spark, [row(i, t) for i, t in enumerate(texts)])
    got = {r.ord: r.group for r in dedupe.duplicate_groups(df, 0.5, "first_fit").collect()}
    assert got == {i: i if i in (0, 1, 263) else 0 for i in range(264)}
    assert len(count) < 20
