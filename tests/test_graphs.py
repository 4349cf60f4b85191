import random

from pyspark.sql import functions as F

from opsdelta.operators import code_rules as CR
from opsdelta.operators import configs as CF
from opsdelta.operators import graph as GR


def graph(spark, pairs, names=None, provides=()):
    names = names or sorted({n for p in pairs for n in p})
    deps = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "`from` string, `to` string, line long")
    nodes = spark.createDataFrame([(n,) for n in names], "name string")
    prov = spark.createDataFrame(list(provides), "resource string, alias string, ord long")
    return GR.resolve_edges(GR.build_edges(deps, deps.limit(0)), nodes, GR.providers(prov))


def test_edges(spark, rows):
    deps = spark.createDataFrame([("a", "b", 3), ("a", "b", 2), ("a", "/server:1", 1), ("a", "alias", 4)], "`from` string, `to` string, line long")
    refs = spark.createDataFrame([("a", "a", 1), ("a", "b", 9)], "`from` string, `to` string, line long")
    edges = GR.build_edges(deps, refs)
    assert rows(edges) == [("a", "alias", "DECLARED", 4), ("a", "b", "DECLARED", 2), ("a", "b", "DISCOVERED", 9)]
    assert [r["constraint"] for r in GR.runtime_constraints(deps).collect()] == ["/server:1"]
    prov = GR.providers(spark.createDataFrame([("y", "alias", 2), ("x", "alias", 1), ("x", "b", 3)], "resource string, alias string, ord long"))
    nodes = spark.createDataFrame([("a",), ("b",), ("x",)], "name string")
    got = {(r["to"], r["kind"]): r["target"] for r in GR.resolve_edges(edges, nodes, prov).collect()}
    assert got == {("b", "DECLARED"): "b", ("b", "DISCOVERED"): "b", ("alias", "DECLARED"): "x"}
    assert GR.unresolved(edges, nodes, prov).count() == 0
    left = GR.unresolved(edges, nodes, prov.limit(0))
    assert [(r["severity"], r["confidence"]) for r in GR.missing_dependencies(left).collect()] == [("HIGH", 0.95)]


def test_cycles(spark):
    pairs = [("s", "s"), ("b", "a"), ("a", "b"), ("q", "r"), ("r", "p"), ("p", "q"), ("d", "e"), ("d", "f"), ("e", "g"), ("f", "g"), ("a", "d"), ("q", "a"), ("h", "zz")]
    want = {("s",), ("a", "b"), ("p", "q", "r")}
    random.Random(1).shuffle(pairs)
    # x and y close a cycle only through the alias that y provides
    edges = graph(spark, pairs + [("x", "lib"), ("y", "x")], names=list("abdefghpqrsxy"), provides=[("y", "lib", 1)])
    found = GR.cycles(edges)
    assert sorted(tuple(r["cycle"]) for r in found.collect()) == sorted(want | {("x", "y")})
    text = {r["resource"]: r for r in GR.cycle_findings(found).collect()}
    assert text["a"]["rendered"] == "a -> b -> a" and len(text["p"]["evidence"]) == 3 and text["s"]["rendered"] == "s -> s"


def test_components_equal_mutual_reach(spark):
    rnd = random.Random(14)
    names = [f"n{i:02d}" for i in range(24)]
    pairs = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(34)})
    reach = {n: {n} for n in names}
    for _ in names:
        for a, b in pairs:
            for n in names:
                if a in reach[n]:
                    reach[n].add(b)
    used = {n for p in pairs for n in p}
    want = {n: min(m for m in used if m in reach[n] and n in reach[m]) for n in used}
    got = {r["name"]: r["component"] for r in GR.components(graph(spark, pairs, names)).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_components_settle_small_reach_by_lists(spark, monkeypatch):
    """Nodes that reach few others need no labels; a long chain, a large ring and a hub still get theirs."""
    monkeypatch.setattr(GR, "REACH", 5)
    ring = lambda p, n: [(f"{p}{i:02d}", f"{p}{(i + 1) % n:02d}") for i in range(n)]
    few = [*ring("a", 3), *ring("b", 2), ("a00", "b01"), ("s", "s"), ("s", "b00"), ("t", "s")]
    many = [*ring("r", 9), ("r04", "a01"), *[("hub", f"x{i}") for i in range(9)], ("x1", "hub"), *[(f"c{i:02d}", f"c{i + 1:02d}") for i in range(12)], ("c12", "a00")]
    both = few + many
    want = {n: n for p in both for n in p}
    want |= {f"a{i:02d}": "a00" for i in range(3)} | {f"b{i:02d}": "b00" for i in range(2)} | {f"r{i:02d}": "r00" for i in range(9)} | {"x1": "hub"}
    assert {r["name"]: r["component"] for r in GR.components(graph(spark, both)).collect()} == want

    def labels(arcs):
        raise AssertionError("labels are spread although every node reaches few")

    monkeypatch.setattr(GR, "_reach_labels", labels)
    got = {r["name"]: r["component"] for r in GR.components(graph(spark, few)).collect()}
    assert got == {n: want[n] for p in few for n in p}


def test_events(spark, rows):
    s = "event string, kind string, resource string, file string, line long, call string, side string, direction string, broadcast boolean"
    e = lambda ev, kind, d=None, bc=None, r="r": (ev, kind, r, "f", 1, "c", "s", d, bc)
    facts = spark.createDataFrame([e("x", "REGISTRATION"), e("x", "TRIGGER", "to-client", True), e("y", "TRIGGER", "local"), e("z", "REGISTRATION"), e(None, "TRIGGER")], s)
    assert rows(GR.event_graph(facts)) == [("x", 1, 1, True, True), ("y", 0, 1, False, False), ("z", 1, 0, False, False)]
    assert rows(GR.dangling_events(GR.event_graph(facts))) == [("y", "NOT_REGISTERED"), ("z", "NOT_TRIGGERED")]
    assert tuple(GR.event_section(facts).first()) == (3, 1, 1, 1, 1, 1)
    assert tuple(GR.event_section(facts.limit(0)).first()) == (0, 0, 0, 0, 0, 0)


def test_config_lines(spark):
    text = "\n".join([
        "ensure a # ensure b", "  Start 'my res'\t// x", "", "# stop a", 'set key "v 1" v2', "setr lone", 'exec "x y.cfg"', "stop [cats]", "ensure", "print hi", "sets u http://x",
    ])
    got = [tuple(r)[1:] for r in CF.config_directives(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("line").collect()]
    assert got == [
        (1, "DIRECTIVE", "ensure", "a", False, None), (2, "DIRECTIVE", "start", "my res", False, None), (5, "VARIABLE", "set", "key", None, "v 1 v2"),
        (6, "VARIABLE", "setr", "lone", None, ""), (7, "EXEC", "exec", "x y.cfg", None, None), (8, "DIRECTIVE", "stop", "[cats]", True, None),
        (11, "VARIABLE", "sets", "u", None, "http:"),
    ]


def test_started_and_missing(spark, rows):
    s = "server_id string, target string, line long, command string"
    d = spark.createDataFrame([("s", "a", 1, "ensure"), ("s", "a", 2, "stop"), ("s", "b", 1, "stop"), ("s", "b", 2, "start"), ("s", "[c]", 3, "ensure"), ("s", "MapManager", 4, "ensure"), ("s", "b", 9, "ensure")], s)
    assert rows(CF.started_resources(d)) == [("s", "MapManager"), ("s", "b")]
    res = spark.createDataFrame([("a",)], "resource string")
    got = {r["target"]: (r["line"], r["severity"], r["confidence"]) for r in CF.ensure_missing(d, res, res.select(F.col("resource").alias("alias"))).collect()}
    assert got == {"b": (2, "HIGH", 0.9), "MapManager": (4, "INFO", 0.2)}


def test_declared_files(spark, rows):
    files = spark.createDataFrame([("r", "client/a.lua"), ("r", "server/b.lua"), ("r", "c.js"), ("q", "client/z.lua")], "resource string, path string")
    s = "resource string, directive string, pattern string, line long, side string, external_resource string"
    d = lambda p, side, ext=None, r="r": (r, "files", p, 1, side, ext)
    decl = spark.createDataFrame([d("client/*.lua", "client"), d("**/*.lua", "server"), d("c.js", "client"), d("no/*.lua", "client"), d("none.lua", "server"), d("x.lua", "client", "other"), d("*.lua", "client")], s)
    got = {r["pattern"]: (r["severity"], r["confidence"]) for r in CF.missing_files(decl, files).collect()}
    assert got == {"no/*.lua": ("MEDIUM", 0.6), "none.lua": ("HIGH", 0.95), "*.lua": ("MEDIUM", 0.6)}
    assert rows(CF.script_sides(decl, files)) == [("q", "client/z.lua", "unknown"), ("r", "c.js", "client"), ("r", "client/a.lua", "shared"), ("r", "server/b.lua", "server")]


def test_manifest_checks_stop_early(spark):
    s = "resource string, kind string, readable boolean, syntax_lines array<long>, fx_version string, games array<string>"
    m = spark.createDataFrame([
        ("none", "none", True, [], None, []), ("dark", "fxmanifest", False, [], None, []), ("torn", "fxmanifest", True, [4], None, []),
        ("bare", "fxmanifest", True, [], None, []), ("odd", "fxmanifest", True, [], "x", ["pong", "gta5"]), ("old", "__resource", True, [], None, []), ("fine", "fxmanifest", True, [], "cerulean", ["gta5"]),
    ], s)
    got = {}
    for r in CF.manifest_checks(m).collect():
        got.setdefault(r["resource"], []).append(r["check"])
    assert {k: sorted(v) for k, v in got.items()} == {
        "none": ["no-manifest"], "dark": ["unreadable"], "torn": ["syntax"], "bare": ["missing-fx-version", "missing-game"],
        "odd": ["unknown-fx-version", "unknown-game"], "old": ["legacy-manifest"],
    }


def test_code_rules(spark, rows):
    s = "file string, line long, name string, string_args array<string>, has_non_literal boolean"
    c = lambda line, name, args=(), other=False: ("f", line, name, list(args), other)
    calls = spark.createDataFrame([c(10, "PerformHttpRequest"), c(9, "load"), c(10, "load", ["x"]), c(70, "load"), c(71, "load"), c(5, "require"), c(6, "io.open", ["log", "a.EXE"]), c(7, "io.open", ["a.txt", "b.exe"])], s)
    assert sorted(r["distance"] for r in CR.proximity_pairs(calls).collect()) == [0, 60]
    assert [(r["loader_count"], r["confidence"]) for r in CR.remote_loads(CR.proximity_pairs(calls)).collect()] == [(2, 0.8)]
    assert sorted(r["line"] for r in CR.dynamic_exec(calls).collect()) == [9, 70, 71]
    assert rows(CR.executable_writes(calls)) == [("f", 6, "io.open", "a.EXE")]
    q = spark.createDataFrame([("f", 1, "MySQL.query", "select * from t", None), ("f", 2, "MySQL.query", " SELECT * FROM t LIMIT 1", "FOR"), ("f", 3, "print", "select * from t", "FOR"), ("f", 4, "oxmysql.x", None, "WHILE")], "file string, line long, call string, sql string, loop_kind string")
    assert sorted((r["line"], r["check"], r["severity"]) for r in CR.query_findings(q).collect()) == [(1, "query-unbounded", "LOW"), (2, "query-loop", "MEDIUM"), (2, "query-star", "INFO"), (4, "query-loop", "HIGH")]
    pos = spark.createDataFrame([("f", 1, 5), ("f", 2, 20), ("f", 3, 100), ("g", 4, 5)], "file string, id long, at long")
    loops = spark.createDataFrame([("f", 0, 50), ("f", 4, 20), ("f", 5, 6)], "file string, start long, end long")
    assert {r["id"]: r["loop_start"] for r in CR.enclosing(pos, loops).collect()} == {1: 5, 2: 0, 3: None, 4: None}
    files = spark.createDataFrame([("a/b.EXE", 1), ("c.lua", 1), ("d", 1), ("e.tar.gz", 1)], "path string, size_bytes long")
    assert sorted((r["path"], r["kind"]) for r in CR.suspicious_files(files).collect()) == [("a/b.EXE", "EXECUTABLE"), ("e.tar.gz", "ARCHIVE")]


def test_components_of_chains_rings_and_tails(spark):
    rnd = random.Random(5)
    names = [f"n{i:03d}" for i in range(120)]
    rnd.shuffle(names)
    chain = list(zip(names[:50], names[1:50]))
    ring = list(zip(names[50:90], names[51:90])) + [(names[89], names[50])]
    pairs = chain + ring + [(names[49], names[50]), (names[70], names[95]), (names[96], names[97]), (names[97], names[96])]
    got = {r["name"]: r["component"] for r in GR.components(graph(spark, pairs)).collect()}
    want = {n: n for p in pairs for n in p}
    want.update({n: min(names[50:90]) for n in names[50:90]})
    want.update({n: min(names[96:98]) for n in names[96:98]})
    assert got == want
    tail = {r["name"]: r["component"] for r in GR.components(graph(spark, chain)).collect()}
    assert tail == {n: n for n in names[:50]}
    assert GR.components(graph(spark, chain).limit(0)).count() == 0


def shortest(pairs):
    """The shortest cycle through each arc, the least of equal ones, by search over paths."""
    found = {}
    for a, b in set(pairs):
        if a == b:
            found[a, b] = (a,)
        front, seen = [(b,)], {b}
        while front and (a, b) not in found:
            grown = sorted(p + (d,) for p in front for s, d in set(pairs) if s == p[-1] and d not in seen)
            first = {}
            for p in grown:
                first.setdefault(p[-1], p)
            if a in first:
                found[a, b] = (a,) + first[a][:-1]
            seen |= set(first)
            front = list(first.values())
    return found


def test_shortest_cycles(spark):
    rnd = random.Random(8)
    names = [f"n{i:02d}" for i in range(14)]
    pairs = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(30)}) + [("n00", "n00")]
    get = lambda p: {(r["from"], r["to"]): tuple(r["cycle"]) for r in GR.shortest_cycles(graph(spark, p)).collect()}
    want = shortest(pairs)
    assert get(pairs) == want and len({len(c) for c in want.values()}) > 2
    # thirty nodes that all depend on each other: one row an arc, where all cycles would never end
    names = [f"n{i:02d}" for i in range(30)]
    dense = [(a, b) for a in names for b in names if a != b]
    assert get(dense) == {(a, b): (a, b) for a, b in dense}
    assert get([("a", "b"), ("b", "c")]) == {}


def test_enclosing_of_short_and_long_loops_equals_a_search_and_copies_no_position(spark):
    rnd = random.Random(5)
    points = [(rnd.choice("abc"), i, rnd.choice([None, *range(-300, 900)])) for i in range(400)] + [("b", 999, 10**9 + 5), (None, 1000, 4)]
    loops = [(rnd.choice("abd"), lo, lo + rnd.choice([0, -3, 1, 7, 90, 1000])) for lo in (rnd.randrange(-300, 900) for _ in range(60))] + [("b", 20, 2 * 10**9), (None, 0, 9)]
    pos = spark.createDataFrame(points, "file string, id long, at long")
    found = CR.enclosing(pos, spark.createDataFrame(loops, "file string, start long, end long"))
    near = lambda f, x: [lo for g, lo, hi in loops if f is not None and f == g and x is not None and lo <= x < hi]
    want = {(f, i, x, max(near(f, x), default=None)) for f, i, x in points}
    assert {tuple(r) for r in found.select("file", "id", "at", "loop_start").collect()} == want and found.count() == len(points)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "id#" not in "".join(line for line in plan.splitlines() if "Generate" in line)
    assert "Aggregate [file" in plan and not any("id#" in line for line in plan.splitlines() if "Aggregate" in line)
