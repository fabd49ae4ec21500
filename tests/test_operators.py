"""Operators on small fixtures with known results."""

from __future__ import annotations

import gzip
import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.functions.text import any_time_stamp, cluster_id, contains_any, has_level, hits, html_text, level, query_terms, rank_terms, recall_weight, safe_name, search_terms, search_weight, time_stamp
from quern.operators import answers, evaluation, graph, lifecycle, logs, retrieval, segments, store, trees, vectors
from quern.operators.components import connected_components
from quern.plans.columns import pick
from quern.plans.prefix import running_total
from quern.plans.quantiles import percentiles
from quern.sources import adhoc, readers

LOG = [
    "2024-03-12T10:00:01 INFO server starting", "2024-03-12T10:00:05 INFO accepting connections", "2024-03-12T10:01:30 WARN slow query detected on /api/users",
    "2024-03-12T10:02:00 ERROR connection refused from 10.0.0.5", "2024-03-12T10:03:15 ERROR connection refused from 10.0.0.6", "2024-03-12T10:05:00 INFO recovered after retry",
    "2024-03-12T10:10:00 DEBUG cache hit ratio 0.83", "2024-03-12T11:00:00 ERROR fatal disk full",
]


@pytest.fixture()
def lines(spark):
    return spark.createDataFrame(list(enumerate(LOG, 1)), "line_no int, text string")


def test_log_filters(lines):
    assert logs.matching(lines, "connection refused", regex=False).count() == 2
    assert logs.scope(lines, level="ERROR").count() == 3
    assert logs.scope(lines, level="WARN").count() == 1
    assert logs.matching(lines, r"10\.0\.0\.\d+").count() == 2
    assert logs.scope(lines, since="2024-03-12 10:02:00", until="2024-03-12 10:09:59").count() == 3
    assert logs.scope(lines, first=2, last=4).count() == 3


def test_log_counts(lines):
    assert tuple(logs.count_pattern(lines, "connection refused").first()) == (8, 2, 25.0)
    assert {r.value for r in logs.top_values(lines, r"from (?P<ip>\S+)").collect()} == {"10.0.0.5", "10.0.0.6"}
    assert [tuple(r) for r in logs.histogram(lines, "ERROR").collect()] == [("2024-03-12T10:00", 2), ("2024-03-12T11:00", 1)]
    assert tuple(logs.count_pattern(lines.limit(0), "x").first()) == (0, 0, 0.0)
    with pytest.raises(ValueError):
        logs.matching(lines, "x" * 1001)
    near = logs.around(lines, F.contains("text", F.lit("WARN")), 1).first()
    assert [c.line_no for c in near.context] == [2, 3, 4]


def test_level_rules(spark):
    rows = spark.createDataFrame([("a WARNING b",), ("warned",), ("prewarn",), (None,)], "t string")
    assert [r[0] for r in rows.select(has_level(F.col("t"), "WARN")).collect()] == [True, True, False, None]
    assert [r[0] for r in rows.select(level(F.col("t"))).collect()] == ["WARN", None, None, None]
    assert rows.select(time_stamp(F.lit("no time"))).first()[0] is None
    stamps = spark.createDataFrame([("Mar  2 10:00:01 host x",), ('1.2.3.4 - [12/Mar/2024:10:00:01 +0000] "GET /"',), ("[2024-03-12 10:00:01] y",), ("99/Foo",)], "t string")
    assert [str(r[0]) for r in stamps.select(any_time_stamp(F.col("t"), 2023)).collect()] == ["2023-03-02 10:00:01", "2024-03-12 10:00:01", "2024-03-12 10:00:01", "None"]


def test_terms():
    assert query_terms('raft "leader election", Raft 数据；x') == ["raft", "leader election", "数据", "x"]
    assert search_terms("the raft of it") == ["raft", "of", "it"]
    assert rank_terms(["1/2000 in UK have abnormal PrP positivity."]) == ["1/2000 in UK have abnormal PrP positivity", "1/2000", "UK", "abnormal", "PrP", "positivity"]
    assert rank_terms(["数据", "ab", "With"]) == ["数据"]
    assert search_weight("PrP/2000") == pytest.approx(1 + 0.5 + 1.0 + 0.6 + 0.4)
    assert recall_weight("abc") == 1


def test_text_functions(spark):
    row = spark.createDataFrame([("aAaa", None, "<ul><li>x</li></ul><p>a &amp; b</p><script>no</script>")], "a string, n string, h string")
    got = row.select(hits(F.col("a"), "aa"), hits(F.col("n"), "a"), contains_any([F.col("a"), F.col("n")], ["%"]), html_text(F.col("h")), safe_name(F.lit("a/b:c. ")), cluster_id(F.array(F.lit("b"), F.lit("a")))).first()
    assert got[0] == 2 and got[1] == 0 and got[2] is False and got[3] == "- x\na & bno" and got[4] == "a_b_c" and len(got[5]) == 24


def _graph(spark):
    return spark.createDataFrame([("A", "B", 10), ("A", "C", 5), ("B", "D", 5), ("C", "D", 3), ("D", "E", 2)], "a string, b string, observation_count int")


def test_expected_walk(spark):
    seeds = spark.createDataFrame([("A",)], "id string")
    got = {r.node: (r.visits * 1000, r.score) for r in graph.expected_walk(_graph(spark), seeds).collect()}
    assert {n: round(v, 3) for n, (v, _) in got.items()} == {"B": 1840.537, "C": 945.756, "D": 818.620, "E": 101.949}
    assert sum(s for _, s in got.values()) == pytest.approx(1)


def test_cooccurrence_and_upsert(spark):
    notes = [("n1", "A"), ("n1", "B"), ("n1", "C"), ("n2", "A"), ("n2", "B"), ("n2", "D"), ("n3", "A"), ("n3", "C")]
    pairs = graph.pair_counts(spark.createDataFrame(notes, "id string, entry_id string"), 2)
    assert {(r.a, r.b): r.observation_count for r in pairs.collect()} == {("A", "B"): 2, ("A", "C"): 2}
    known = spark.createDataFrame([("A", "C", 1)], "a string, b string, observation_count long")
    merged = store.upsert(known, pairs, ["a", "b"], {"n": F.coalesce("o.observation_count", F.lit(0)) + F.coalesce("n.observation_count", F.lit(0))})
    assert {(r.a, r.b): r.n for r in merged.collect()} == {("A", "B"): 2, ("A", "C"): 3}


def test_tag_overlap(spark):
    tags = {"A": "raft paxos dist", "B": "raft paxos dist net common", "C": "raft net", "D": "py web common"}
    rows = [(e, t) for e, ts in tags.items() for t in ts.split()] + [(f"F{i}", "common") for i in range(50)]
    got = graph.tag_overlap(spark.createDataFrame(rows, "entry_id string, tag_id string"), (2, 40), 2, 0.3)
    assert {(r.a, r.b): (round(r.jaccard, 2), r.weight) for r in got.collect()} == {("A", "B"): (0.6, 6), ("B", "C"): (0.4, 4)}


def test_components_of_long_paths_take_few_jobs(spark):
    edges = spark.range(6000).filter("id % 1500 <> 7").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    spark.sparkContext.setJobGroup("paths", "")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("paths"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    firsts = [0, 8, 1508, 3008, 4508]
    assert got == {n: max(f for f in firsts if f <= n) for n in range(6001)}
    assert jobs <= 40, jobs


@pytest.mark.parametrize("cell", [1, 7, 1 << 18])
def test_components_from_cells_of_any_size(spark, cell):
    rng = random.Random(cell)
    edges = {(rng.randrange(300), rng.randrange(300)) for _ in range(170)} | {(1000, n) for n in range(400, 460)} | {(5, 5)}
    parent = {n: n for e in edges if e[0] != e[1] for n in e}
    root = lambda n: n if parent[n] == n else root(parent[n])
    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    for kind, name in (("long", int), ("string", lambda n: f"{n:04}")):
        got = connected_components(spark.createDataFrame([(name(a), name(b)) for a, b in sorted(edges)], f"a {kind}, b {kind}"), cell=cell).collect()
        assert sorted(tuple(r) for r in got) == sorted((name(n), name(root(n))) for n in parent)


def test_components_and_clusters(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    tags = spark.createDataFrame([(i, t) for i in range(41) for t in ("x", "y", "z", f"own{i}")], "entry_id long, tag_id string")
    found = graph.clusters(spark.createDataFrame(chain, "a long, b long"), tags, 10, 3).collect()
    assert [(r.component, r.members, r.tags) for r in found] == [(0, 41, ["x", "y", "z"])]


def test_trees(spark):
    rows = [("r", None, "root", False), ("a", "r", "a", False), ("b", "a", "b", True), ("c", "b", "c", False), ("x", "y", "x", False), ("y", "x", "y", False)]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, name string, deleted boolean")
    assert {r.id for r in trees.subtree(nodes, nodes.filter("id = 'r'").select("id")).collect()} == {"r", "a"}
    assert {r.id for r in trees.subtree(nodes, nodes.filter("id = 'x'").select("id")).collect()} == {"x", "y"}
    assert trees.paths(nodes, nodes.filter("id = 'c'").select("id")).first().path == "root/a/b/c"
    assert trees.nearest_live(nodes, nodes.filter("id = 'b'").select("id")).first().ancestor == "a"
    moves = spark.createDataFrame([("a", "c"), ("c", "r")], "id string, parent_id string")
    assert {r.id: r.cycle for r in trees.would_cycle(nodes, moves).collect()} == {"a": True, "c": False}


def test_deep_trees(spark):
    """A chain of 200, a cycle that hangs below nothing and one with a tail."""
    rows = [(i, i - 1 if i else None, f"n{i}", False) for i in range(200)] + [(300, 302, "a", False), (301, 300, "b", False), (302, 301, "c", False), (303, 302, "d", False), (400, 999, "orphan", False)]
    nodes = spark.createDataFrame(rows, "id long, parent_id long, name string, deleted boolean")
    below = trees.subtree(nodes, spark.createDataFrame([(0,), (150,), (300,)], "id long")).collect()
    got = {(r.root, r.id): r.depth for r in below}
    assert len(got) == len(below) == 200 + 50 + 4
    assert all(got[0, i] == i for i in range(200)) and all(got[150, i] == i - 150 for i in range(150, 200))
    assert {i: got[300, i] for i in (300, 301, 302, 303)} == {300: 0, 301: 1, 302: 2, 303: 3}
    up = trees.ancestors(nodes, spark.createDataFrame([(199,), (303,), (400,), (77777,)], "id long")).collect()
    far = {(r.id, r.ancestor): r.distance for r in up}
    assert len(far) == len(up) == 200 + 4 + 2 and all(far[199, i] == 199 - i for i in range(200))
    assert {a: d for (i, a), d in far.items() if i == 303} == {303: 0, 302: 1, 301: 2, 300: 3} and far[400, 999] == 1
    assert trees.paths(nodes, nodes.filter("id = 199").select("id")).first().path == "/".join(f"n{i}" for i in range(200))
    assert trees.would_cycle(nodes, spark.createDataFrame([(0, 199), (199, 0)], "id long, parent_id long")).filter("cycle").first().id == 0


def test_pairs_of_large_groups(spark):
    rows = [("big", i) for i in range(60)] + [("small", i) for i in (1, 2, 70)] + [("other", i) for i in range(0, 60, 7)]
    m = spark.createDataFrame(rows, "id string, entry_id long")
    whole = {(r.a, r.b): r.observation_count for r in graph.pair_counts(m, 1).collect()}
    assert whole == {(r.a, r.b): r.observation_count for r in graph.pair_counts(m, 1, cell=7).collect()}
    assert len(whole) == 60 * 59 // 2 + 2 and whole[1, 2] == 2 and whole[0, 7] == 2


def test_percentiles(spark):
    rows = [("a", float(v)) for v in (5, 1, 1, 1, 9, 3.5)] + [("b", 2.0)] + [(None, float(i % 10)) for i in range(1000)] + [("c", None)]
    got = {r.g: (r.p, r.q, r.top) for r in percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p": 0.5, "q": 0.9, "top": 1.0}).collect()}
    assert got.keys() == {"a", "b", None}
    assert got["a"] == pytest.approx((2.25, 7.0, 9.0)) and got["b"] == (2.0, 2.0, 2.0) and got[None] == pytest.approx((4.5, 8.1, 9.0))


def test_judgements_lines_and_limits(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n1\ta\t-0.5\n1\tb\t1.9\n1 0 c 2\n1\td\tnan\n1\ta\t-1.2\n")
    assert {r.entry_id: r.rel for r in readers.read_judgements(spark, str(tmp_path / "q.tsv")).collect()} == {"a": -1, "b": 1, "c": 2}
    (tmp_path / "logs").mkdir()
    for name, n in (("x.log", 2000), ("y.log", 3)):
        (tmp_path / "logs" / name).write_text("".join(f"{name} line {i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    got = readers.read_lines(spark, str(tmp_path / "logs")).collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 2003 and all(r.text.endswith(f" line {r.line_no}") and r.text.split()[0] in r.path for r in got)
    with pytest.raises(ValueError, match="more than 1000"):
        readers.read_table(spark, str(tmp_path / "logs" / "x.log"), "csv", max_bytes=1000)
    assert readers.write_csv(spark.range(5), str(tmp_path / "out"), 3)
    (part,) = (tmp_path / "out").glob("*.csv")
    assert part.read_bytes() == b"\xef\xbb\xbfid\n0\n1\n2\n"


def test_quota_and_rerank(spark):
    rows = []
    for i in range(5):
        rows += [(1, f"o{i}", None, i + 1, i + 1), (1, f"t{i}", i + 1, None, None), (1, f"l{i}", None, i + 10, None), (1, f"s{i}", None, None, i + 10)]
    merged = spark.createDataFrame(rows, "query_id int, entry_id string, tag_rank int, lexical_rank int, semantic_rank int")
    chosen = retrieval.select_evidence(retrieval.scored(merged), 10).orderBy("place").collect()
    assert [r.bucket for r in chosen] == ["overlap"] * 4 + ["tag"] * 2 + ["lexical"] * 2 + ["semantic"] * 2
    judged = retrieval.scored(merged.filter("tag_rank IS NULL"))
    chosen = retrieval.select_evidence(judged, 10, retrieval.EVAL_QUOTAS).orderBy("place").collect()
    assert [r.bucket for r in chosen] == ["overlap"] * 4 + ["lexical"] * 4 + ["semantic"] * 2
    listed = spark.createDataFrame([(1, f"e{i}", i + 1) for i in range(5)], "query_id int, entry_id string, place int")
    scores = spark.createDataFrame([(1, "e2", 0.9), (1, "e0", 0.5), (1, "e1", 0.1)], "query_id int, entry_id string, score double")
    assert [r.entry_id for r in retrieval.rerank(listed, scores, 3).orderBy("place").collect()] == ["e2", "e0", "e1", "e3", "e4"]


def test_metadata_rank(spark):
    rows = spark.createDataFrame([(1, "a.txt", "UK study: abnormal PrP positivity 1/2000", None, None, "x", "txt"), (2, "b.txt", "generic notes", None, None, "study of abnormal things", "txt")], "entry_id int, display_name string, summary string, file_extra string, extra string, description string, original_ext string")
    rows = rows.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    tags = spark.createDataFrame([(2, "topic", "abnormal"), (1, "form", "pdf")], "entry_id int, facet string, name string")
    got = store.search_metadata(rows, "1/2000 in UK have abnormal PrP positivity.", tags).collect()
    assert [r.entry_id for r in got] == [1, 2]
    assert got[1].bonus == pytest.approx(8.0 * 1.5)
    asked = store.search_metadata(rows, "abnormal", tags, requested=["pdf"]).collect()
    # 14 x 1.5 + 5 + 1.5 + 4 for the first, 6 x 1.5 + 5 + 8 x 1.5 for the second
    assert {r.entry_id: r.score for r in asked} == {1: pytest.approx(31.5), 2: pytest.approx(26.0)}


def test_recall_components(spark):
    row = spark.createDataFrame([("raft raft raft", "raft", "text", True, 0, True)], "display_name string, summary string, kind string, partial boolean, chunks int, cut boolean")
    got = row.select(retrieval.field_match(["raft", "none"]), retrieval.evidence_utility(F.col("summary"), F.col("partial"), F.col("chunks"), F.col("cut"))).first()
    assert got[0] == pytest.approx(2.0 + 0.5) and got[1] == pytest.approx(0.4 - 0.2)
    ranks = spark.createDataFrame([(1, 1, 1), (1, None, None), (None, 1, 1), (1, 1, None), (1, None, 1)], "tag_rank int, lexical_rank int, semantic_rank int")
    assert [round(r[0], 6) for r in ranks.select(retrieval.overlap_bonus()).collect()] == [4.0, 1.2, 1.5, 2.0, 1.7]
    assert [r[0] for r in ranks.select(retrieval.bucket()).collect()] == ["overlap", "tag", "overlap", "tag", "tag"]


def test_evaluation(spark):
    run = spark.createDataFrame([("q1", "d1", 1), ("q1", "d2", 2), ("q2", "d3", 1)], "query_id string, entry_id string, place int")
    qrels = spark.createDataFrame([("q1", "d2", 2), ("q1", "d9", 1), ("q2", "d3", 0)], "query_id string, entry_id string, rel int")
    (row,) = evaluation.per_query(run, qrels, 2).collect()
    assert (row.query_id, row.first_rank, row.hit, row.recall, row.reciprocal_rank) == ("q1", 2, 1, 0.5, 0.5)
    assert row.ndcg == pytest.approx((3 / 1.584962500721156) / (3 + 1 / 1.584962500721156), abs=1e-6)
    assert evaluation.summary(evaluation.per_query(run, qrels, 1)).first().hit_at_k == 0


def test_vectors(spark):
    records = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("b", 1, [0.6, 0.8])], "entry_id string, section_id int, vector array<float>")
    queries = spark.createDataFrame([(0, [0.0, 1.0])], "query_id int, query array<float>")
    assert [(r.entry_id, r.score) for r in vectors.search(records, queries, 2).orderBy("rank").collect()] == [("a", 1.0), ("b", 0.8)]
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, query array<double>")
    assert {(r.entry_id, r.section_id) for r in vectors.best_sections(records, asked).collect()} == {("a", 2), ("b", 1)}


def test_index_refresh_and_log_hits(spark, lines):
    index = spark.createDataFrame([("h1", [1.0])], "text_hash string, vector array<double>")
    kept, new = vectors.refresh(index, spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h1")], "entry_id int, text_hash string"))
    assert sorted(r.entry_id for r in kept.collect()) == [1, 3] and [r.entry_id for r in new.collect()] == [2]
    hits_ = logs.pattern_hits(lines, r"\d{2}:\d{2}", 3, 1).collect()
    assert [(r.line_no, r.hit) for r in hits_] == [(2, 0), (3, 0), (4, 0)] and hits_[1].level == "WARN"
    assert logs.at_least(lines, "error").count() == 3


def test_restructure_and_snapshots(spark):
    nodes = spark.createDataFrame([("r", None, "R", False), ("a", "r", "A", False), ("b", "a", "B", False), ("c", "b", "C", False)], "id string, parent_id string, name string, deleted boolean")
    entries = spark.createDataFrame([(1, "a"), (2, "c")], "entry_id int, catalog_id string")
    ops = spark.createDataFrame([(1, "move", "a", "c"), (2, "rename", "b", "x"), (3, "rename", "b", "y"), (4, "delete", "a", "r")], "seq int, op string, id string, target string")
    got, placed = store.restructure(nodes, entries, ops)
    # the move below itself is refused; the children and entries of a go to r
    assert {r.id: (r.parent_id, r.name, r.deleted) for r in got.collect()} == {"r": (None, "R", False), "a": ("r", "A", True), "b": ("r", "y", False), "c": ("b", "C", False)}
    assert {r.entry_id: r.catalog_id for r in placed.collect()} == {1: "r", 2: "c"}
    rows = "k int, updated_at string, deleted_at string, side string"
    remote = spark.createDataFrame([(1, "1", None, "r"), (2, "5", None, "r"), (3, "1", "4", "r")], rows)
    local = spark.createDataFrame([(1, "1", None, "l"), (2, "4", None, "l"), (3, "4", None, "l"), (4, "1", None, "l")], rows)
    assert {r.k: r.side for r in store.merge_snapshots(remote, local, "k").collect()} == {1: "l", 2: "r", 3: "r", 4: "l"}


def test_lifecycle(spark):
    tasks = spark.createDataFrame([(1, "k", "running", 5, "2024-01-01"), (2, "k", "pending", 0, "2024-01-01"), (3, "j", "done", 0, "2024-01-01")], "id int, dedup_key string, status string, attempts int, t string")
    tasks = tasks.withColumn("lease_until", F.col("t").cast("timestamp_ntz")).withColumn("scheduled_at", F.col("lease_until"))
    assert {r.id: r.status for r in lifecycle.recover(tasks, "2024-01-02").collect()} == {1: "dead", 2: "pending", 3: "done"}
    assert {r.id: r.status for r in lifecycle.active_keys(tasks, "2024-01-02").collect()} == {1: "dead", 2: "pending", 3: "done"}
    new = spark.createDataFrame([(9, "k", "pending", 0, "x"), (8, "j", "pending", 0, "x"), (7, "j", "pending", 0, "x")], "id int, dedup_key string, status string, attempts int, t string")
    grown = lifecycle.enqueue(tasks.drop("lease_until", "scheduled_at"), new)
    assert sorted(r.id for r in grown.collect()) == [1, 2, 3, 7]
    pairs = spark.createDataFrame([("a", "b", 5), ("a", "c", 4), ("a", "d", 3), ("a", "e", 2)], "a string, b string, observation_count long")
    known = spark.createDataFrame([("a", "c"), ("a", "e")], "a string, b string")
    assert {(r.b, r.is_new) for r in lifecycle.capped_new(pairs, known, 1).collect()} == {("b", True)}
    assert {r.b for r in lifecycle.capped_new(pairs, known, 5).collect()} == {"b", "c", "d", "e"}


def test_paths_and_prefixes(spark):
    tracked = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "3")], "path string, sha string")
    found = spark.createDataFrame([("a", "1"), ("b", "9"), ("z", "3"), ("n", "8")], "path string, sha string")
    got = {(r.old, r.new, r.status) for r in store.reconcile_paths(tracked, found).collect()}
    assert got == {("a", "a", "in_sync"), ("b", "b", "modified"), ("c", "z", "moved"), ("d", None, "missing"), (None, "n", "new")}
    ids = spark.createDataFrame([("abcdefgh1",), ("abcdefgh2",)], "id string")
    wanted = spark.createDataFrame([("abcdefgh",), ("abcdefgh2",), ("abc",), ("zzzzzzzz",)], "prefix string")
    assert {(r.prefix, r.matches, r.id) for r in store.resolve_prefix(ids, wanted).collect() if r.matches} == {("abcdefgh", 2, None), ("abcdefgh2", 1, "abcdefgh2")}


def test_admission():
    assert adhoc.admit("SELECT replace(a, ';', 'set') FROM t1; ").endswith("t1")
    for bad in ("DROP TABLE t1", "SELECT 1; SELECT 2", "INSERT INTO t1 VALUES (1)", "SELECT reflect('a', 'b')", "EXPLAIN SELECT 1"):
        with pytest.raises(adhoc.RefusedSQL):
            adhoc.admit(bad)
    assert adhoc.reconcile("""SELECT 'say "Name" now', "N ame", `"Name"` -- "Name"\n/* "Name" */""", ["name"]) == ("""SELECT 'say "Name" now', `name`, `"Name"` -- "Name"\n/* "Name" */""", ("N ame -> name",))


def test_adhoc_sql_sees_its_tables_alone(spark):
    mine = spark.createDataFrame([(1, "x", True)], "load long, use string, `set` boolean")
    spark.range(3).createOrReplaceTempView("secret")
    spark.range(7).createOrReplaceTempView("t1")
    spark.range(2).createOrReplaceGlobalTempView("shared")
    for bad in (
        "SELECT count(*) FROM secret", "SELECT * FROM t1 JOIN t2", "SELECT * FROM global_temp.shared", "SELECT * FROM parquet.`/x`", "SELECT * FROM csv.`x`", "WITH x AS (SELECT 1) DELETE FROM t1",
        "WITH x AS (SELECT 1) INSERT INTO secret SELECT * FROM x", "SELECT 1 WHERE EXISTS (SELECT 1 FROM secret)", "WITH s AS (SELECT * FROM secret) SELECT * FROM s", "SELECT * FROM (SELECT 1) s, LATERAL (SELECT * FROM secret)",
    ):
        with pytest.raises(adhoc.RefusedSQL):
            adhoc.run_sql(spark, [mine], bad)
    assert adhoc.run_sql(spark, [mine], "WITH s AS (SELECT load, use, `set` FROM t1) SELECT * FROM s, T1 WHERE s.use = 'FROM secret'").rows.count() == 0
    assert adhoc.run_sql(spark, [mine], "SELECT load, use FROM t1 -- all of it").rows.collect() == [(1, "x")]
    assert spark.table("t1").count() == 7 and not [t.name for t in spark.catalog.listTables() if t.name.startswith("bound_")]
    for name in ("secret", "t1"):
        spark.catalog.dropTempView(name)


def test_adhoc_sql_is_judged_on_resolved_names(spark, tmp_path):
    mine = spark.createDataFrame([(1,)], "a int")
    spark.range(3).createOrReplaceTempView("secret")
    spark.range(3).write.parquet(str(tmp_path / "hidden"))
    spark.udf.register("spy", lambda x: x, "int")
    for bad in (
        "SELECT 'CTE [secret]' AS x, secret.* FROM secret", "SELECT a AS `CTE [secret]`, s.* FROM t1, secret s", "SELECT o.* FROM (WITH secret AS (SELECT 1 AS k) SELECT k FROM secret) i, secret o",
        "SELECT * FROM IDENTIFIER('sec' || 'ret')", "SELECT * FROM range(3)", f"SELECT * FROM parquet.`{tmp_path}/hidden`", "SELECT (SELECT max(id) FROM secret) AS m FROM t1", "SELECT a FROM t1 WHERE a IN (SELECT id FROM secret)",
        "SELECT 1) UNION SELECT * FROM (SELECT id FROM secret", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT spy(a) FROM t1", "SELECT input_file_name() FROM t1",
    ):
        with pytest.raises(adhoc.RefusedSQL):
            adhoc.run_sql(spark, [mine], bad)
    good = {
        "WITH secret AS (SELECT 7 AS k) SELECT k FROM secret": [(7,)], "SELECT * FROM VALUES (1, 2) v": [(1, 2)], "SELECT e FROM t1 LATERAL VIEW explode(array(a, 5)) x AS e": [(1,), (5,)],
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT n FROM r": [(1,), (2,), (3,)], "SELECT reflect FROM (SELECT 'input_file_name()' AS reflect)": [("input_file_name()",)],
    }
    for text, rows in good.items():
        assert sorted(tuple(r) for r in adhoc.run_sql(spark, [mine], text).rows.collect()) == rows
    spark.catalog.dropTempView("secret")


def test_adhoc_pages(spark):
    page = adhoc.run_sql(spark, [spark.range(100, numPartitions=4)], "SELECT id FROM t1 ORDER BY id", limit=10, offset=85)
    assert [r.id for r in page.rows.collect()] == list(range(85, 95)) and page.has_more()
    assert not adhoc.run_sql(spark, [spark.range(5)], "SELECT id FROM t1", limit=5).has_more()
    whole = adhoc.run_sql(spark, [spark.range(100, numPartitions=4)], "SELECT id + 1 AS n FROM t1", limit=None)
    assert whole.rows.rdd.getNumPartitions() == 4 and whole.rows.count() == 100 and not whole.has_more()


def test_adhoc_sql(spark):
    people = spark.createDataFrame([("alice", 30, "engineer"), ("bob", 25, "designer"), ("carol", 40, "engineer"), ("dave", 35, "manager"), ("eve", 28, "engineer")], "name string, age int, role string")
    page = adhoc.run_sql(spark, [people], 'SELECT "Name" FROM t1 WHERE age > 30 ORDER BY age DESC')
    assert [r[0] for r in page.rows.collect()] == ["carol", "dave"] and page.fixes == ("Name -> name",)
    with pytest.raises(adhoc.RefusedSQL, match="did you mean role"):
        adhoc.run_sql(spark, [people], "SELECT roles FROM t1")


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,age\n"x, y",3\nz,4\n')
    csv = readers.read_table(spark, str(tmp_path / "a.csv"), "csv")
    assert [tuple(r) for r in csv.collect()] == [("x, y", 3), ("z", 4)]
    assert readers.write_csv(csv, str(tmp_path / "out"), limit=1) is True
    assert readers.sniff(None, "x.TSV") == "tsv" and readers.sniff(None, None, "application/json") == "json" and readers.sniff("exe", "b") is None
    with gzip.open(tmp_path / "l.log.gz", "wb") as f:
        f.write("\n".join(LOG).encode("utf-16"))
    assert readers.read_log(spark, str(tmp_path / "l.log.gz")).orderBy("line_no").first().text == LOG[0]
    assert readers.decode(b"\xe9") == "é"
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(d) for d in ({"_id": "d1", "title": "T", "text": "x"}, {"id": "d2"}, {"text": "no id"})))
    assert {r.doc_id for r in readers.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()} == {"d1", "d2"}
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1 0 d2 2.7\nq1\td1\t0\nbad\n")
    assert {(r.entry_id, r.rel) for r in readers.read_judgements(spark, str(tmp_path / "q.tsv")).collect()} == {("d1", 0), ("d2", 2)}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.txt", "hi")
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        t.add(tmp_path / "a.csv", "in/a.csv")
    assert {(r.member, r.size) for r in readers.archive_members(spark, f"{tmp_path}/*.[zt]*").collect()} >= {("m.txt", 2)}
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "f").write_text("x")
    assert all("/.hidden" not in r.path for r in readers.hashed_files(spark, str(tmp_path)).collect())
    readers.write_snapshot({"t": csv}, str(tmp_path / "snap"))
    assert readers.read_snapshot(spark, str(tmp_path / "snap"), "t", "name string, age int").count() == 2


def test_streaming_matches_batch(spark, tmp_path):
    from quern.streaming import windows

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    q = windows.tumbling(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windows.tumbling(events).collect()))


def test_plan_helpers(spark):
    clash = spark.createDataFrame([(1, 2, 3)], "a int, A int, b int")
    assert pick(clash, "a", "b").columns == ["a", "b"] and pick(clash, "A").first()[0] == 2
    with pytest.raises(ValueError):
        pick(clash, "missing")
    rows = spark.range(500).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 3).alias("g"), "id", F.xxhash64("id").alias("h"))
    got = running_total(rows, ["g"], "h", ["id"], F.col("id"), "before", 5).collect()
    for g in (None, 1, 2):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.h & (2**64 - 1))
        total = 0
        for r in own:
            assert r.before == total
            total += r.id
    assert len(got) == 500


def test_document_parts(spark):
    from quern.operators import documents as parts

    assert parts.fold_lines("aa\nbb\ncccccc\nd", 6) == [(0, 1, 2, "aa\nbb"), (1, 3, 3, "cccccc"), (2, 4, 4, "d")]
    docs = spark.createDataFrame([(1, "# A\nx\n## B\ny\n# C\nz"), (2, ""), (3, None)], "doc_id int, text string")
    got = [tuple(r)[1:] for r in parts.sections(docs).orderBy("first_line").collect()]
    assert got == [("A", 1, 1, 4), ("B", 2, 3, 4), ("C", 1, 5, 6)]
    assert [r.text for r in parts.chunks(docs, 8).collect()] == ["# A\nx", "## B\ny", "# C\nz"]
    answer = spark.createDataFrame([(1, 'Yes[^1].\n[^1]: entry_id=`abc`, quote="a \\"b\\" c", slide=4 | fits\n[^2]: nothing')], "id int, text string")
    (c,) = parts.citations(answer).collect()
    assert (c.marker, c.quote, c.page, c.reason) == ("1", 'a "b" c', "4", "fits")
    pages = spark.createDataFrame([(1, 1, "Hello, ＷＯＲＬＤ"), (1, 2, "hello world")], "doc_id int, page int, text string")
    quotes = spark.createDataFrame([(7, 1, "HELLO world!"), (8, 1, "other"), (9, 1, "..")], "quote_id int, doc_id int, quote string")
    assert {r.quote_id: r.page for r in parts.first_page(pages, quotes).collect()} == {7: 1, 8: None, 9: None}
    mail = b"Subject: Hi\r\nFrom: a@x\r\nTo: b@x\r\nContent-Type: text/html\r\n\r\n<p>body</p>"
    (m,) = parts.mails(spark.createDataFrame([(1, bytearray(mail))], "id int, content binary")).collect()
    assert m.subject == "Hi" and m.is_html and m.attachments == [] and m.sent is None
    tables = spark.createDataFrame([("a;b\n1;2\n",), ("a,b;c\n1,2;3",), ("plain text",), (None,)], "t string")
    assert [r[0] for r in tables.select(parts.delimiter(F.col("t"))).collect()] == [";", ";", None, None]
    paths = spark.createDataFrame([("a/b/c.py",), ("a/c.py",), ("../x",), (".git/config",), ("/etc/p",)], "p string")
    assert [r[0] for r in paths.select(parts.matches_glob(F.col("p"), "a/*.py")).collect()] == [True, True, False, False, False]
    assert [r[0] for r in paths.select(parts.matches_glob(F.col("p"), "**/*.py")).collect()] == [True, True, False, False, False]
    assert [r[0] for r in paths.select(parts.listable(F.col("p"))).collect()] == [True, True, False, False, False]
    labels = {"**Verdict: support**": "SUPPORT", "x\n verdict : CONTRADICT.": "CONTRADICT", "Verdict: INSUFFICIENT, though accurate": "INSUFFICIENT", "Verdict: supported": "SUPPORT", "It cannot be verified.": "INSUFFICIENT"}
    labels |= {"The study does not support this": "CONTRADICT", "Consistent with the data": "SUPPORT", "dunno": None, "": None, None: None, "not enough info": None}
    said = spark.createDataFrame([(t,) for t in labels], "t string")
    assert [r[0] for r in said.select(parts.verdict(F.col("t"))).collect()] == list(labels.values())
    with pytest.raises(ValueError):
        parts.chart(docs, "doc_id", "text", "mode")


def test_clusters_covered_by_views(spark):
    clusters = spark.createDataFrame([("k", ["a", "b", "c"]), ("l", ["x", "y", "z"])], "id string, tags array<string>")
    views = spark.createDataFrame([(["a", "b"],), (["x"],)], "tags array<string>")
    assert [r.id for r in graph.uncovered(clusters, views).collect()] == ["l"]


def test_vetting_and_strength(spark):
    rows = spark.createDataFrame([(None, None, 1, 0), (True, "2023-01-01", 1, 1), (True, "2024-02-01", 7, 1), (True, "2024-02-01", 6, 1)], "vetted boolean, at string, observation_count int, vetted_observation_count int")
    rows = rows.withColumn("vetted_at", F.col("at").cast("timestamp_ntz"))
    assert [r[0] for r in rows.select(graph.needs_vetting("2024-03-01")).collect()] == [True, True, True, False]
    s = {"tag": 1, "note": 2}
    pairs = spark.createDataFrame([("note", "tag"), ("tag", "note"), ("tag", None)], "a string, b string")
    assert [r[0] for r in pairs.select(graph.stronger(F.col("a"), F.col("b"), s)).collect()] == [True, False, True]


def test_throughput(spark):
    at = lambda minute: f"2024-01-01 10:{minute:02d}:00"
    rows = [
        (1, "ingest_file", None, "done", at(0), at(1), at(3)), (2, "ingest_file", None, "done", at(0), at(1), at(2)), (3, "ingest_file", None, "dead", at(0), None, at(4)),
        (4, "ingest_file", None, "running", at(1), at(2), None), (5, "ingest_file", None, "running", at(1), at(2), None), (6, "ingest_file", None, "running", at(1), at(2), None),
        (7, "ingest_file", None, "pending", at(5), None, None), (8, "ingest_file", None, "pending", "2024-01-01 12:00:00", None, None), (9, "ingest_file", "user", "done", at(0), at(5), at(4)),
        (10, "ingest_file", None, "done", at(0), at(0), "2023-12-31 10:00:00"), (11, "mine", None, "done", at(0), at(0), at(1)), (12, "reprocess_file", None, "failed", at(0), at(0), at(1)),
    ]
    tasks = spark.createDataFrame(rows, "id int, kind string, scheduled_by string, status string, scheduled_at string, started_at string, finished_at string")
    tasks = tasks.select("id", "kind", "scheduled_by", "status", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("scheduled_at", "started_at", "finished_at")])
    got = {r.kind: r for r in lifecycle.throughput(tasks, at(20), window_minutes=60).collect()}
    assert set(got) == {"ingest_file", "reprocess_file"}
    one = got["ingest_file"]
    assert (one.pending, one.running, one.done, one.failed, one.oldest_pending_age_seconds, one.average_duration_seconds) == (2, 3, 2, 1, 900, 90.0)
    assert round(one.success_rate, 3) == 0.667 and one.completed_per_minute == 2 / 60
    two = got["reprocess_file"]
    # a start after the end counts as no time
    assert (two.pending, two.running, two.done, two.failed, two.oldest_pending_age_seconds, two.average_duration_seconds, two.success_rate) == (0, 0, 1, 0, 0, 0.0, 1.0)
    empty = lifecycle.throughput(tasks.filter("false"), at(20)).collect()
    assert [(r.done, r.success_rate, r.average_duration_seconds) for r in empty] == [(0, None, None)] * 2


def test_quoted_evidence_tells_the_marked_page(spark):
    reads = [
        (1, "e", 1, 3, None, None, "[Page 1]\nnothing\n[Page 2]\nthe quote is here\n[Page 3]\nend"), (2, "e", 1, 3, None, None, "the quote is here, no marks"), (3, "e", 4, None, None, None, "the QUOTE, is here"),
        (4, "e", None, None, 7, 7, "the quote is here"), (5, "e", None, None, None, None, "# Slide 3: intro\nx\n# Slide 4: more\nthe quote is here"), (6, "e", 9, 9, None, None, "## OCR Page 12\nthe quote is here"),
        (7, "e", 1, 9, None, None, "[Page 1]\nthe quote is here\n[Page 5]\nthe quote is here"), (8, "other", 1, 1, None, None, "the quote is here"), (9, "e", 5, 2, None, None, "the quote is here"), (10, "e", 3, 3, None, None, "the quote is here\n[Page 9]\nx"),
        (11, "e", 1, 1, None, None, None), (12, "e", 1, 2, None, None, "[Page 1]\nthe quote\n[Page 2]\nis here"),
    ]
    reads = spark.createDataFrame(reads, "turn int, entry_id string, page_start int, page_end int, slide_start int, slide_end int, text string")
    cites = spark.createDataFrame([(t, t, "e", "The quote is here", None) for t in range(1, 14)] + [(20, 7, "e", "the quote is here", 5), (21, 7, "e", "the quote is here", 2), (22, 2, "e", "the quote is here", 2), (23, 1, "e", " ", None)], "cite_id int, turn int, entry_id string, quote string, page int")
    got = {r.cite_id: (r.supported, r.page_supported, r.page) for r in answers.quoted_evidence(cites, reads).collect()}
    seen = lambda page: (True, True, page)
    assert got == {
        1: seen(2), 2: seen(None), 3: seen(4), 4: seen(7), 5: seen(4), 6: seen(12), 7: seen(None), 8: (False, True, None), 9: seen(None), 10: seen(3), 11: (False, True, None), 12: (False, True, None), 13: (False, True, None),
        20: seen(5), 21: (True, False, None), 22: (True, False, None), 23: (False, True, None),
    }


def test_reads_of_segments(spark):
    text = "# One\r\nalpha beta\r\n## Two: more\nBETA gamma\nlast beta\n# Three\nend\n\n# 第 一章 start\nfin"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    known = spark.createDataFrame([(1, 1, "s1", "Lines", ("lines", "2-3")), (1, 2, "s2", "Two", ("lines", "Two")), (1, 3, "s3", "nowhere", ("lines", "x"))], "doc_id int, position int, id string, title string, anchor struct<unit:string,value:string>")
    ask = lambda **x: x
    asked = [
        ask(pattern="("), ask(pattern="beta"), ask(pattern="beta", max_matches=1, match_offset=1), ask(pattern="beta", line_start=4, context_lines=1), ask(pattern="beta", match_offset=9), ask(pattern="zzz"), ask(pattern="^last.*\n# T"),
        ask(line_end=2), ask(line_start=2), ask(line_start=3, line_end=2), ask(line_start=99), ask(offset=5, max_chars=3), ask(section_id="s1"), ask(section_id="s2"), ask(section_id="s3"), ask(section_id="s9"), ask(heading="two"), ask(heading="third"),
        ask(heading="第一章"), ask(line_start=1, line_end=2, offset=4, max_chars=5), ask(heading="Three", offset=3, max_chars=4),
    ]
    rows = [tuple([i, 1, *[a.get(n) for n in segments.ARGUMENTS]]) for i, a in enumerate(asked)] + [tuple([50, 2, *[None] * len(segments.ARGUMENTS)])]
    requests = spark.createDataFrame(rows, "request_id int, doc_id int, " + ", ".join(f"{n} {t}" for n, t in segments.ARGUMENTS.items()))
    got = {r.request_id: r for r in segments.read_segments(docs, requests, known).collect()}
    assert len(got) == len(rows) and got[0].error.startswith("invalid regex") and got[0].how == "pattern"
    assert got[1].part.startswith("[L2] beta\n  ┊ # One\nalpha beta\n## Two: more\nBETA gamma\n\n[L4] BETA") and (got[1].total, got[1].next, got[1].first_line, got[1].last_line) == (3, None, 2, 5)
    assert (got[2].first_line, got[2].total, got[2].next) == (4, 3, 2) and got[3].part == "[L4] BETA\n  ┊ BETA gamma\nlast beta\n\n[L5] beta\n  ┊ BETA gamma\nlast beta\n# Three"
    assert got[4].error == "match_offset 9 exceeds total_matches 3" and got[5].error == "no matches" and got[6].first_line == 5
    assert (got[7].part, got[7].how, got[7].first_line, got[7].last_line) == ("# One\nalpha beta", "lines", 1, 2) and got[8].part == "alpha beta" and got[9].error == "line_end must be >= line_start" and got[10].error == "empty result"
    assert (got[11].part, got[11].next, got[11].first_line) == ("\r\na", 8, 1) and got[12].part == "alpha beta\n## Two: more"
    assert got[13].part == "Two: more\nBETA gamma\nlast beta" and (got[14].part, got[14].error) == ("", None) and got[15].error == "section not found: s9"
    assert got[16].part == "Two: more\nBETA gamma\nlast beta" and got[17].error == "section not found: third" and got[18].part == "# 第 一章 start\nfin" and got[18].first_line == 9
    assert (got[19].part, got[19].next) == ("e\nalp", 9) and (got[20].part, got[20].total) == ("hree", 11) and (got[50].part, got[50].total, got[50].error) == ("", 0, None)
    assert segments.read_segments(docs, requests.filter("section_id = 's1'")).first().error == "section_id lookup needs a map of sections"


def plain_checkpoint(lists, budget):
    """Drops one item after another and writes the whole checkpoint again each time."""
    state = {k: list(v) for k, v in answers.CHECKPOINT.items() if k != "version"} | {k: [json.loads(x) for x in v] for k, v in lists.items()}

    def critical():
        out = []
        for kind in ("constraints", "key_decisions", "next_steps"):
            for x in state[kind]:
                x = x if len(x) <= 800 else x[:800].rstrip() + "…"
                out += [x] if x not in out else []
        out += ["Evidence entry IDs: " + ", ".join(state["evidence_entry_ids"])] if state["evidence_entry_ids"] else []
        return (out + ["Evidence locator: " + json.dumps(e, ensure_ascii=False) for e in state["evidence"]])[-20:]

    while True:
        state["critical_context"] = critical()
        if len(json.dumps({"version": 1} | state, ensure_ascii=False).encode()) <= budget:
            break
        spare = [k for k in answers.DROP_ORDER if len(state[k]) > (k in ("goal", "progress"))] or [k for k in answers.DROP_ORDER if state[k]]
        if not spare:
            break
        state[spare[0]].pop(0)
    return {k: v for k, v in state.items() if v}


def test_checkpoints_fit_their_budget(spark):
    said = [(1, t, "user" if t % 2 == 0 else "assistant", f"{'You must keep é ' + str(t % 6) + '. Never mind.' if t % 2 == 0 else 'We decided on plan ' + str(t % 7) + '. Next: do it. See entry_id=abcdef0' + str(t % 4)} {'x' * t}") for t in range(60)]
    said += [(2, 0, "user", "y" * 3000), (2, 1, "assistant", None), (3, 0, "user", None), (4, 0, "user", "")]
    calls = [(1, t, 0, "read", json.dumps({"view_id": f"v{t % 3}", "q": "z" * t * 30}), json.dumps({"results": [{"entry_id": "abcdef01", "page": t, "quote": ""}, {"deep": [{"entry_id": "abcdef02", "page": 2}]}], "said": "entry_id=abcdef0123"}), None) for t in range(1, 40, 2)]
    calls += [(1, 41, 0, None, "not json", None, " broken "), (1, 43, 1, "read", None, "[]", None)]
    turns = spark.createDataFrame(said, "conv_id int, turn int, role string, text string")
    calls = spark.createDataFrame(calls, "conv_id int, turn int, position int, name string, input string, output string, error string")
    read = lambda df: {c: {k: [json.loads(r.item) for r in sorted(g, key=lambda r: r.place)] for k, g in kinds.items()} for c, kinds in grouped(df).items()}

    def grouped(df):
        out = {}
        for r in df.collect():
            out.setdefault(r.conv_id, {}).setdefault(r.kind, []).append(r)
        return out

    whole = read(answers.checkpoint_items(turns, 10**7, calls))
    assert set(whole) == {1, 2} and len(whole[1]) == 10 and len(whole[1]["goal"]) == 30 and len(whole[1]["critical_context"]) == 20
    assert whole[1]["tool_history"][-2]["error"] == "broken" and whole[1]["scopes"] == [{"view_id": "v1"}, {"view_id": "v0"}, {"view_id": "v2"}] and {"entry_id": "abcdef02", "page": 2} in whole[1]["evidence"]
    lists = {k: [json.dumps(x, ensure_ascii=False) for x in v] for k, v in whole[1].items() if k != "critical_context"}
    for budget in (300, 700, 1500, 4000, 9000, 20000):
        assert read(answers.checkpoint_items(turns, budget, calls))[1] == plain_checkpoint(lists, budget), budget
