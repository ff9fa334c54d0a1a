"""Results stay whole, and work stays in proportion, where a key is common or a table is large."""

from __future__ import annotations

import contextlib
import threading

from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import components, fanout, paths, routes, store, token_index
from quarry.plans import tables


@contextlib.contextmanager
def within(spark, seconds):
    """Cancels the jobs that still run after so many seconds."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def on_one_file(spark, n):
    ids = spark.range(n)
    docs = ids.select(F.concat(F.lit("d"), "id").alias("id"), F.array(F.lit("a.py"), F.concat(F.lit("b"), F.col("id") % 3)).alias("files"))
    return ids, docs


def test_hops_and_documents_of_one_file_are_not_paired(spark):
    ids, docs = on_one_file(spark, 200_000)
    hops = ids.select(F.concat(F.lit("h"), F.col("id") % 20).alias("hop"), F.lit("a.py").alias("file"))
    hops = hops.unionByName(spark.createDataFrame([("lost", "none.py"), ("nowhere", None)], "hop string, file string"))
    themes = ids.where("id % 4 = 0").select(F.lit("t").alias("cluster_id"), F.concat(F.lit("d"), "id").alias("element_id"))
    with within(spark, 60):
        got = {r["cluster_id"]: (r["hops"], r["docs"]) for r in G.bundle(hops, docs, themes).collect()}
    assert got == {"t": (20, 50_000), None: (22, 150_000)}


def test_documents_meet_only_the_best_routes_of_a_file(spark):
    ids, docs = on_one_file(spark, 100_000)
    routes = ids.select(F.concat(F.lit("r"), "id").alias("route"), F.when(F.col("id") == 70_000, "b1").otherwise("a.py").alias("file"), (F.col("id") % 7 + 1).cast("int").alias("depth"))
    routes = routes.unionByName(routes)
    with within(spark, 60):
        got = G.document_routes(docs, routes, 2)
        n = got.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("r", "route"))).alias("r")).groupBy("r").count().collect()
    assert [([x["route"] for x in r["r"]], r["count"]) for r in n] == [(["r0", "r10003"], 100_000)]


def test_lineage_is_whole_beyond_a_million_edges(spark):
    access = spark.range(1_000_100).select(F.concat(F.lit("o"), "id").alias("consumer"), F.lit("c").alias("schema_id"), F.lit("reads").alias("role"))
    edges = spark.createDataFrame([("a", "b", "call")], "caller string, callee string, edge_type string")
    assert G.data_layer(edges, access, F.lit(True)).count() == 1_000_101
    assert G.data_layer(edges, access, F.lit(True), 5).count() == 6


def test_tables_of_distinct_keys_have_the_rows_of_their_fragments(spark, tmp_path, monkeypatch):
    lines = [(k, p, s, n) for k in (1, 5, 8, 20, 21, None) for p in (0, 3, 5, None) for s in (0, 2, 3, -1, None) for n in (1, 2, 3, None)]
    spark.createDataFrame(lines + lines[::2], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").withColumn("l_quantity", F.lit(3.0)).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(1, 7), (5, 123), (5, 223), (8, None), (8, 3), (20, 3), (20, 703), (21, 9)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {t: sorted(map(tuple, tables.kb(spark, str(tmp_path), t).collect()), key=repr) for t in tables.KEYED}
    monkeypatch.setattr(tables, "KEYED", {})
    for t, rows in got.items():
        assert rows == sorted(map(tuple, tables.kb(spark, str(tmp_path), t).collect()), key=repr), t
        assert len(rows) > 20


def test_edges_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(tables, "LINES_A_TASK", 1000)
    edges = tables.kb(spark, "/root/testdata/sf0.01", "sym_edges")
    most = edges.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert edges.count() > 100_000 and most < 4 * 1000


def test_callers_of_a_common_type_are_counted_once_for_all_requests(spark):
    n = 15_000
    i = spark.range(n)
    cols = [F.lit("s").alias("source_name"), F.lit("a/f.py").alias("file"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end")]
    symbols = i.select(F.concat(F.lit("c"), "id").alias("id"), *cols, F.concat(F.lit("m.Caller"), "id").alias("qname"))
    symbols = symbols.unionByName(spark.createDataFrame([("wide", "m.Wide"), ("few", "m.Few"), ("one", "m.One")], "id string, qname string").select("id", *cols, "qname"))
    refs = [i.select(F.concat(F.lit("c"), "id").alias("caller"), F.lit("wide").alias("callee")), i.where("id < 3").select(F.concat(F.lit("c"), "id").alias("caller"), F.lit("few").alias("callee")), i.where("id = 1").select(F.lit("c1").alias("caller"), F.lit("one").alias("callee"))]
    edges = refs[0].unionByName(refs[1]).unionByName(refs[2]).select("caller", "callee", F.lit("type_ref").alias("edge_type"), F.lit("a/f.py").alias("file"), F.lit(5).alias("line"))
    cited = i.select(F.col("id").alias("q"), F.lit("s").alias("source_name"), F.explode(F.array(*map(F.lit, ["m.Wide", "m.Few", "m.One", "m.Gone"]))).alias("name"), F.lit(0).alias("hop"))
    questions = i.select(F.col("id").alias("q"), F.lit("s").alias("source_name"), F.lit("what of wide few one gone").alias("question"))
    with within(spark, 90):
        got = token_index.reference_bridges(cited, questions, symbols, edges, target_limit=5)
        counts = {(r["target"], r["gated"], r["caller"]): r["count"] for r in got.groupBy("target", "gated", "caller").count().collect()}
    assert counts == {("m.Wide", True, None): n} | {("m.Few", False, f"m.Caller{k}"): n for k in range(3)}


def test_postings_are_not_dealt_out_before_they_are_looked_up(spark, capsys):
    i = spark.range(500)
    symbols = i.select(F.concat(F.lit("i"), "id").alias("id"), F.lit("s").alias("source_name"), F.lit("a/f.py").alias("file"), F.col("id").alias("line_start"), F.lit("method").alias("kind"), F.concat(F.lit("m.Thing"), "id").alias("qname"), F.lit("m").alias("parent"))
    postings, _ = token_index.token_index(symbols, bucket_rows=64)
    postings.explain()
    plan = capsys.readouterr().out
    assert "Exchange hashpartitioning" not in plan and "Generate explode" in plan
    assert postings.groupBy("token").count().where("token in ('thing', 'm') and count = 500").count() == 2


def test_menus_of_requests_need_no_rounds_and_are_the_same_by_rounds(spark, monkeypatch):
    hops = [(q, f"m.n{(q * 7 + k * k) % 23}", f"m.n{(q + 3 * k) % 23}.x", "call") for q in range(40) for k in range(q % 9 + 1)] * 2
    hops += [(90, "m.a", "m.a", "call"), (91, "m.a", None, "call"), (91, None, "m.b", "call"), (92, "é", "z", "x"), (92, "z", "\U0001f600", "x"), (92, "z", "\uffee", None), (None, "m.a", "m.b", "call")]
    hops += [(95, f"m.c{k:02}", f"m.c{k + 1:02}", "call") for k in range(60)]
    table = spark.createDataFrame(hops, "q long, a string, b string, relation string")
    told = spark.createDataFrame([(q, f"R{k}", a) for k, (q, a, _, _) in enumerate(hops)] + [(95, "R", "m.none"), (97, "R", "m.a")], "q long, route string, symbol string")
    menu = lambda: sorted(map(tuple, routes.component_menu(table, told).collect()))
    by_rounds = components.connected_components

    def never(*_):
        raise AssertionError("rounds over all requests")

    monkeypatch.setattr(components, "connected_components", never)
    whole = menu()
    assert [r[:7] for r in whole if r[0] > 89] == [(90, 1, 1, 1, "", "m.a", ""), (91, 1, 1, 1, "m.a", "", ""), (92, 1, 4, 3, "é", "z", "\uffee, \U0001f600"), (95, 1, 61, 60, "m.c00", "m.c01, m.c02, m.c03, m.c04", "m.c60")]
    monkeypatch.setattr(components, "connected_components", by_rounds)
    monkeypatch.setattr(components, "CHUNK_ROWS", 24)
    assert menu() == whole


def test_families_are_dealt_once(spark, capsys):
    i = spark.range(1000)
    rows = i.select(F.floor(F.col("id") / 50).alias("q"), (F.col("id") % 3).alias("obligation"), F.lit("m").alias("module"), F.concat(F.lit("m.A.f"), "id").alias("entry"), F.lit("m.z").alias("terminal"), F.array(F.lit("call")).alias("relations"), F.array(F.lit("x")).alias("nodes"), F.lit(0).alias("identity"), F.lit(1).alias("overlap"), (F.col("id") % 5).alias("relevance"), F.lit(1).alias("direction"), F.lit("f").alias("file"), F.col("id").alias("line"))
    got = routes.family_ledger(rows)
    got.explain()
    assert capsys.readouterr().out.count("Exchange ") == 1
    assert {r["status"]: r["count"] for r in got.groupBy("status").count().collect()} == {"kept": 120, "origin-cap": 60, "owner-cap": 820}


def test_levels_and_rounds_of_fanouts_do_not_join_the_symbols_again(spark, monkeypatch):
    i = spark.range(777)
    symbols = i.select(F.concat(F.lit("i"), "id").alias("id"), F.lit("s").alias("source_name"), F.lit("a/f.py").alias("file"), F.col("id").alias("line_start"), F.col("id").alias("line_end"), F.concat(F.lit("m.Thing"), "id").alias("qname"), F.lit("m").alias("parent"))
    edges = i.select(F.concat(F.lit("i"), "id").alias("caller"), F.concat(F.lit("i"), F.col("id") + 1).alias("callee"), F.lit("call").alias("edge_type"), F.lit("a/f.py").alias("file"), F.col("id").alias("line"))
    requests = spark.createDataFrame([(1, "s", "m.Thing7"), (2, "s", "m.Thing775")], "q long, source_name string, name string")
    plans = []
    cut = fanout.cut
    monkeypatch.setattr(fanout, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    got = fanout.call_fanout(requests, symbols, edges, 4, 3, 3, 12)
    assert sorted((r["q"], r["hop"], r["target"]) for r in got.collect()) == [(1, 1, "m.Thing8"), (1, 2, "m.Thing9"), (1, 3, "m.Thing10"), (2, 1, "m.Thing776")]
    assert plans and not any("Range (0, 777" in p for p in plans)


def test_of_the_last_level_of_a_search_only_ends_are_kept(spark):
    edges = spark.range(500).select(F.lit("a").alias("caller"), F.concat(F.lit("b"), "id").alias("callee")).unionByName(spark.range(500).select(F.concat(F.lit("b"), "id").alias("caller"), F.concat(F.lit("c"), "id").alias("callee")))
    starts = spark.createDataFrame([("k", "a")], "start string, id string")
    ends = spark.createDataFrame([("k", "c7"), ("k", "b3"), ("other", "c8"), ("k", "none")], "start string, id string")
    seen = paths.predecessors(edges, starts, 2, 200, ends)
    assert sorted((r["id"], r["parent"]) for r in seen.where("level = 2").collect()) == []  # c7 comes after b7, which is not of the 200 smallest ids
    seen = paths.predecessors(edges, starts, 2, 500, ends)
    assert [(r["id"], r["parent"]) for r in seen.where("level = 2").collect()] == [("c7", "b7")]
    assert seen.where("level = 1").count() == 500


def test_citations_group_only_cited_edges_in_as_many_tasks_as_asked(spark):
    edges = spark.range(2000).select(F.concat(F.lit("a"), F.col("id") % 50).alias("caller"), F.concat(F.lit("b"), F.col("id") % 40).alias("callee"), F.when(F.col("id") < 200, "call").otherwise("implements").alias("edge_type"))
    ways = spark.createDataFrame([(1, ["a1", "b1", "a1"]), (2, ["a1", "b1"]), (3, ["a3"]), (4, [])], "id long, route array<string>")
    got = G.route_citations(ways, edges, 7)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, "a1", "b1", "call"), (2, 0, "a1", "b1", "call")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [a") < plan.index("LeftSemi") and plan.count("RepartitionByExpression") >= 2 and ", 7" in plan


def test_a_slice_reads_its_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("a", "b", "call"), ("a", "b", "call"), ("b", "a", "call"), ("b", "c", "call"), ("a", "local 1", "call"), (None, "a", "call"), ("c", None, "call"), ("a", None, "call")]
    edges = spark.createDataFrame(rows, "caller string, callee string, edge_type string").mapInArrow(count, "caller string, callee string, edge_type string")
    symbols = spark.createDataFrame([("a", "s"), ("b", "t"), ("c", "t")], "id string, source_name string")
    got = sorted((tuple(r) for r in store.slice_source(symbols, edges, "s", 3).collect()), key=str)
    assert got == sorted([("a", "b", "call"), ("b", "a", "call"), ("a", "s::local 1", "call"), (None, "a", "call"), ("a", None, "call")], key=str)
    assert seen.value == len(rows)


def test_a_walk_reads_all_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    kind = "caller string, callee string, edge_type string, line long, file string"
    rows = [("a", "b", "call", 1, "f"), ("b", "c", "call", 2, "f"), ("d", "b", "implements", 3, "f"), ("x", "y", "call", 4, "f")]
    symbols = spark.createDataFrame([(i, "f", 1) for i in "abcdxy"], "id string, file string, line_start long")
    got = G.chain_walk(spark.createDataFrame(rows, kind).mapInArrow(count, kind), symbols, spark.createDataFrame([("a",)], "id string"), 2).collect()
    assert [(r["parent"], r["id"], r["relation"], r["reason"]) for r in sorted(got, key=lambda r: r["seq"])] == [("a", "b", "call", "descended"), ("b", "c", "call", "depth"), ("b", "d", "implemented_by", "leaf")]
    assert seen.value == len(rows)


def test_matches_of_documents_read_their_tables_once_or_twice(spark):
    """A hub with callers of one name, lines of one edge, members that are mentioned beyond the quota, and a parent that is no symbol."""
    symbol = lambda i, q, parent=None: (i, "s", "core/f.py", q, parent)
    rows = [symbol("hub", "m.Hub"), *(symbol(f"h{k}", f"m.Hub.part{k}", "m.Hub") for k in range(30)), symbol("u", "m.None.part", "m.None"), ("hub2", "t", "core/f.py", "m.Hub", None)]
    rows += [symbol(f"c{k}", f"m.{('Alpha', 'Beta', 'Delta', 'Gamma')[k % 4]}.run") for k in range(400)]
    edges = [(f"c{k}", "hub", "call", line) for k in range(400) for line in range(3)] + [("hub", "h0", "type_ref", 1), ("h1", "hub2", "call", 1), ("hub", "hub", "call", 1)]
    read = {"symbols": spark.sparkContext.accumulator(0), "edges": spark.sparkContext.accumulator(0)}

    def counted(df, name):
        n = read[name]

        def each(batches):
            for b in batches:
                n.add(b.num_rows)
                yield b

        return df.mapInArrow(each, df.schema)

    symbols = counted(spark.createDataFrame(rows, "id string, source_name string, file string, qname string, parent string").coalesce(1), "symbols")
    refs = counted(spark.createDataFrame(edges, "caller string, callee string, edge_type string, line int").coalesce(1), "edges")
    docs = [(q, "s", r, names, mentions) for q in (1, 2) for r, names, mentions in ((0, ["A title", "m.Hub"], [f"part{k}" for k in range(29, 9, -1)]), (3, ["m.None", "m.Hub.part29"], None))]
    documents = spark.createDataFrame(docs, "q int, source_name string, rank int, names array<string>, mentions array<string>")
    asked = spark.createDataFrame([(1, "who will run m.Hub"), (2, "which gamma needs m.Hub")], "q int, question string")
    got = [tuple(r) for r in routes.document_matches(documents, asked, symbols, refs).orderBy("q", "n").collect()]
    assert all(1 <= n.value <= most * len(t) for n, t, most in ((read["symbols"], rows, 2), (read["edges"], edges, 1)))
    for q in (1, 2):
        # the title's document has room for eight roots, all of them mentioned members, in the order of their mention
        assert [r[2] for r in got if r[0] == q and r[5] == 0] == [f"m.Hub.part{k}" for k in range(29, 21, -1)]
    routed = lambda names: routes.document_matches(spark.createDataFrame([(1, "s", 0, names, []), (2, "s", 0, names, None)], documents.schema), asked, symbols, refs).orderBy("q", "n").collect()
    hub = [tuple(r) for r in routed(["m.Hub"])]
    for q, callers in ((1, ["Alpha", "Beta", "Delta"]), (2, ["Gamma", "Alpha", "Beta"])):
        assert [r[2] for r in hub if r[0] == q and r[2].endswith("> m.Hub")] == [f"m.{k}.run > m.Hub" for k in callers]
        assert ("m.Hub > m.Hub.part0", "core/f.py", 0) in {r[2:5] for r in hub if r[0] == q}
        assert not any("None" in r[2] for r in [*hub, *got])
