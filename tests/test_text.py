from pyspark.sql import functions as F

from weftline.functions import text as x
from weftline.operators import text as t


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/").replace("_dot_", "."), v) for k, v in texts.items()], "file string, text string")


def named(spark, *rows):
    return spark.createDataFrame(list(rows), "file string, text string")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def tuples(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_globs(spark):
    m = lambda p, g: one(spark, x.matches_glob(F.lit(p), g))
    assert m("src/ui/a/b.ts", "src/ui/**") and m("src/a.ts", "src/*") and not m("src/a/b.ts", "src/*")
    assert m("a.b", "a.b") and not m("axb", "a.b") and m("node_modules/x", "**/node_modules/**")


def test_boundaries(spark):
    b = lambda p: tuple(one(spark, x.boundary(F.lit(p))))[:2]
    assert b("dist/x.js") == ("generated", 0.95) and b("src/a.ts") == ("user", 0.85) and b("zzz") == ("user", 0.5)
    assert one(spark, x.is_library(F.lit("vendor/x.go"))) and not one(spark, x.is_library(F.lit("src/x.go")))


def test_redaction_and_prompts(spark):
    r = lambda v: one(spark, x.redact(F.lit(v)))
    assert r("Bearer abc.def x") == "Bearer [REDACTED] x" and r("AKIA" + "A" * 16) == "AKIA[REDACTED]"
    assert r("-----BEGIN RSA PRIVATE KEY-----\nabc") == "[REDACTED: private key detected]"
    assert r('token = "f00"') == 'token = "[REDACTED]"'
    assert one(spark, x.is_unsafe_prompt(F.lit("please rm  -rf /"))) and not one(spark, x.is_unsafe_prompt(F.lit("hello")))


def test_small_functions(spark):
    assert one(spark, x.camel_case(F.lit("user_name_x"))) == "userNameX" and one(spark, x.camel_case(F.lit("plain"))) == "plain"
    assert one(spark, x.severity_rank(F.lit("high"))) == 2 and one(spark, x.severity_rank(F.lit("odd"))) == -1
    assert one(spark, x.role_edge_type(F.lit(6))) == "IMPORTS" and one(spark, x.role_edge_type(F.lit(8))) == "CALLS"
    assert one(spark, x.symbol_kind(F.lit("`f`()."))) == "function" and one(spark, x.symbol_kind(F.lit("A#"))) == "class"
    assert one(spark, x.contract_type(F.lit("api/openapi.yaml"))) == "openapi" and one(spark, x.contract_type(F.lit("a.txt"))) == "unknown"
    assert one(spark, x.stem(F.lit("a/b.test.ts"))) == "b.test" and one(spark, x.dirname(F.lit("a"))) == "."
    assert one(spark, x.progress_bar(F.lit(0.5), 4)) == "##--"


def test_imports_and_their_resolution(spark):
    f = named(spark, ("src/a.ts", "import { B } from './b';\nconst c = require('../lib/c.js');\nexport * from 'react';"), ("src/b.ts", ""), ("lib/c.js", ""), ("run.sh", "source ./lib.sh\n. common.sh"), ("src/d.ts", "import x from './missing'"))
    found = t.imports(f)
    assert tuples(found, "source", "target", "line_no") == [("run.sh", "./lib.sh", 1), ("run.sh", "common.sh", 2), ("src/a.ts", "../lib/c.js", 2), ("src/a.ts", "./b", 1), ("src/a.ts", "react", 3), ("src/d.ts", "./missing", 1)]
    got = {(r["source"], r["target"]): r["resolved"] for r in t.resolve_imports(found, f).collect()}
    assert got == {("src/a.ts", "./b"): "src/b.ts", ("src/a.ts", "../lib/c.js"): "lib/c.js", ("src/d.ts", "./missing"): None, ("run.sh", "./lib.sh"): None}


def test_import_map(spark):
    f = named(spark, ("a.ts", "import D, { x, y as z } from './m';\nimport * as ns from 'n';"))
    assert tuples(t.import_map(f), "name", "module") == [("D", "./m"), ("ns", "n"), ("x", "./m"), ("z", "./m")]


def test_symbols_definitions_calls(spark):
    f = named(spark, ("a.ts", "export class A extends B implements C {\n}\nfunction run(q: string): Result {\n  step(q);\n  return last(q);\n}\nfunction step(v) {\n  run(v)\n}"))
    got = set(tuples(t.symbols(f), "edge_type", "name"))
    assert {("DEFINES", "A"), ("EXTENDS", "B"), ("IMPLEMENTS", "C"), ("DEFINES", "run"), ("RETURNS_TYPE", "Result")} <= got
    assert tuples(t.function_index(f), "name", "line_no") == [("run", 3), ("step", 7)]
    assert t.find_definition(f, "step").first()["line_no"] == 7
    assert tuples(t.calls(f), "caller", "callee") == [("run", "last"), ("run", "step"), ("step", "run")]
    assert tuples(t.parameter_flow(f, "step"), "line_no", "arguments") == [(4, "q")]
    assert [r["line_no"] for r in t.usages(f, "run").collect()] == [3, 8]
    kinds = spark.createDataFrame([("foo(x)",), ("return x",), ("y = x",), ("go(x)",)], "line string").select(t.usage_kind(F.col("line"), "x").alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["parameter_pass", "return_value", "assignment", "parameter_pass"]
    assert one(spark, t.definition_kind(F.lit("const x = 1"), "x")) == "variable"


def test_contracts(spark):
    f = named(spark, ("a.proto", "service Users {\n rpc GetUser (Q) returns (R);\n}\nmessage Q {}"), ("s.graphql", "type T {\n}\nquery getT"), ("t.ts", "export interface I {}\ntype X = 1"))
    assert tuples(t.contract_symbols(f), "symbol") == [("GetUser",), ("I",), ("Q",), ("T",), ("Users",), ("X",), ("getT",)]
    j = named(spark, ("o.json", '{"paths": {"/u": {"get": {}, "post": {}}}, "components": {"schemas": {"U": {}}}}'))
    assert tuples(t.openapi_json(j), "symbol") == [("GET /u",), ("POST /u",), ("U",)]
    y = named(spark, ("o.yaml", "paths:\n  /u:\n    get:\n      x: 1\n    post:\ncomponents:\n  schemas:\n    U:\n      type: object"))
    assert tuples(t.openapi_yaml(y), "symbol") == [("GET /u",), ("POST /u",), ("U",)]
    assert tuples(t.local_symbols(named(spark, ("l.ts", "function f() {}\nconst g = async (x) => 1\nconst h = 3"))), "symbol") == [("f",), ("g",)]


def test_decision_records(spark):
    f = named(spark, ("docs/adr/0001-x.md", "# ADR-001: Use Kafka\n\n## Status\nAccepted\n\n## Context\nWe need\nqueues.\n## Decision\nUse `KafkaClient`."), ("adr/2-y.md", "# 2. Keep it\n## Status\nProposed"))
    got = {r["id"]: r for r in t.decision_records(f).collect()}
    assert got["001"]["title"] == "Use Kafka" and got["001"]["context"] == "We need queues." and got["001"]["status"] == "Accepted"
    assert got["2"]["title"] == "Keep it" and got["2"]["decision"] is None
    words = one(spark, t.record_keywords(F.lit("Use `run()` of UserStore, MAX_SIZE in src/a/b.ts and the system file x.ts; getUser This")))
    assert words == ["run()", "UserStore", "getUser", "MAX_SIZE", "b.ts", "x.ts", "src/a/b.ts"]


def test_link_keywords(spark):
    k = spark.createDataFrame([("ADR-1", "User"), ("ADR-1", "none")], "record string, keyword string")
    n = spark.createDataFrame([("1", "User", "a.ts"), ("2", "UserStore", "b.ts"), ("3", "x", "User/c.ts"), ("4", "y", "d.ts")], "id string, symbol string, file_path string")
    e = spark.createDataFrame([("ADR-1", "2", "ADR_RELATED")], "source_id string, target_id string, edge_type string")
    assert tuples(t.link_keywords(k, n, e), "target_id") == [("1",), ("3",)]
    assert t.link_keywords(k, n, e, most=1).count() == 1


def test_link_keywords_equals_a_loop(spark):
    """Keywords of any length, some of which overlap, repeat in a text, share a beginning, or stand in symbol and path."""
    words = ["", "a", "ab", "aba", "abab", "abc", "bca", "b.c", "é", "éa", "%", "x" * 9]
    texts = ["ababab", "abc", "abcabca", "ab", "a", "", "b.c", "bxc", "éaé", "x" * 12, None]
    nodes = [(f"{i}-{j}", s, p) for i, s in enumerate(texts) for j, p in enumerate(texts)]
    k = spark.createDataFrame([(f"r{i % 3}", w) for i, w in enumerate(words)] + [("r0", "abc"), ("r1", None)], "record string, keyword string")
    n = spark.createDataFrame(nodes, "id string, symbol string, file_path string")
    none = spark.createDataFrame([], "source_id string, target_id string, edge_type string")
    for most in (3, 200):
        want = set()
        for r, w in {(r["record"], r["keyword"]) for r in k.collect() if r["keyword"] is not None}:
            hits = sorted((s != w, i) for i, s, p in nodes if w in (s or "") and s is not None or w in (p or "") and p is not None)
            want |= {(r, i) for _, i in hits[:most]}
        assert set(tuples(t.link_keywords(k, n, none, most), "source_id", "target_id")) == want


def test_link_keywords_compares_only_by_a_key(spark):
    """No plan has a join without a key, which compares every keyword with every node."""
    k = spark.createDataFrame([("r", "User")], "record string, keyword string")
    n = spark.createDataFrame([("1", "User", "a.ts")], "id string, symbol string, file_path string")
    e = spark.createDataFrame([], "source_id string, target_id string, edge_type string")
    assert "NestedLoop" not in t.link_keywords(k, n, e)._jdf.queryExecution().executedPlan().toString()


def test_tables(spark):
    text = "### Container Inventory\n| Name | Path |\n|---|---|\n| api | src/api |\n| db | src/db |\n## Dependencies\n| Component | Dependency |\n|:--|--|\n| api | db, cache |\n| db | none |"
    f = named(spark, ("c4.md", text))
    assert tuples(t.c4_components(f), "c0", "c1") == [("api", "src/api"), ("db", "src/db")]
    assert tuples(t.c4_dependencies(f), "component", "dependency") == [("api", "cache"), ("api", "db")]


def test_anomalies(spark):
    text = "\n".join([
        "import { used, unused } from './m';",
        "async function load_all() {",
        "  const user_name = await used();",
        "  console.log(user_name);",
        "  try {",
        "    await used();",
        "  } catch (e) {",
        "  }",
        "  var old = 1;",
        "  go().then(a).then(b);",
        "}",
    ])
    got = set(tuples(t.anomalies(named(spark, ("a.ts", text))), "line_no", "rule"))
    assert {(1, "unused_import"), (2, "snake_function"), (3, "unhandled_await"), (3, "snake_variable"), (4, "console_use"), (7, "catch_without_log"), (9, "var_use"), (10, "promise_without_catch"), (10, "promise_chain")} <= got
    assert (6, "unhandled_await") not in got
    clean = "export function add(a, b) {\n  return a + b;\n}"
    assert t.anomalies(named(spark, ("b.ts", clean))).count() == 0
    row = t.anomalies(named(spark, ("a.ts", text))).filter("rule = 'snake_variable'").first()
    assert row["suggestion"] == "rename to userName" and row["function"] == "load_all" and row["confidence"] == 0.6


def test_patterns(spark):
    f = spark.createDataFrame([(f"src/{n}Service.ts", "x?.y\nif (a === null) {}\nasync function f() {") for n in "ABC"], "file string, text string")
    s = t.suffix_patterns(f).first()
    assert (s["suffix"], s["count"]) == ("Service", 3) and abs(s["confidence"] - 1 / 3) < 1e-9
    p = t.learn_patterns(f, [("null_check", r"\?\.|=== null", 2), ("rare", "never", 3), ("many", "async", 5)])
    got = {r["pattern"]: (r["occurrences"], round(r["confidence"], 3)) for r in p.collect()}
    assert got == {"null_check": (6, 1.0), "many": (3, 0.6)}
    learned = spark.createDataFrame([("async_try_catch", 0.9), ("error_logging", 0.5)], "pattern string, confidence double")
    assert t.pattern_violations(f, learned).count() == 3


def test_complexity_and_skeleton(spark):
    code = "function f(a) {\n  if (a && b) {\n    x();\n  }\n  for (;;) {}\n  y();\n}\nconst z = 1;"
    f = named(spark, ("a.ts", code), ("b.py", "def g():\n    a\n    b\n\n    c\nx = 1"))
    assert t.complexity(f).filter("function = 'f'").first()["complexity"] == 4
    got = {r["file"]: r for r in t.skeleton(f, keep=1).collect()}
    assert got["a.ts"]["text"] == "function f(a) {\n  if (a && b) {\n    // ...\n}\nconst z = 1;"
    assert got["b.py"]["text"] == "def g():\n    a\n    # ...\nx = 1" and got["b.py"]["n_lines"] == 6
    assert tuples(t.signatures(f), "file", "name") == [("a.ts", "f"), ("b.py", "g")]
    assert one(spark, t.is_balanced(F.lit("f(){}"))) and not one(spark, t.is_balanced(F.lit("f({}")))
    r = t.compression(f, t.skeleton(f, keep=0)).first()
    assert 0 < r["ratio"] < 1


def test_corpus_and_profile(spark):
    f = named(spark, ("a.ts", "x\ny"), ("b.md", "z"), ("node_modules/c.ts", "w"))
    assert tuples(t.corpus(f, ["ts"], ["node_modules/**"]), "file", "text") == [("a.ts", "x y")]
    p = named(spark, ("p.md", "# Stack\n- **Language**: Go\nRuntime: JVM"))
    assert tuples(t.section_values(p), "section", "key", "value") == [("Stack", "Language", "Go"), ("Stack", "Runtime", "JVM")]


def test_empty_and_null_texts(spark):
    f = named(spark, ("a.ts", ""), ("b.ts", None))
    for op in (t.imports, t.symbols, t.anomalies, t.calls, t.contract_symbols, t.local_symbols, t.complexity):
        assert op(f).count() == 0
    assert t.skeleton(f).count() == 2


def test_files_within_a_budget_of_lines(spark):
    f = spark.createDataFrame([("a", "x\n\ny"), ("b", " \n"), ("c", "1\n2\n\n3\n4"), ("d", "never")], "file string, text string")
    rows = lambda n: [(r["file"], r["used"], r["text"], r["truncated"]) for r in t.concatenated(f, n).orderBy("file").collect()]
    assert rows(5) == [("a", 2, "x\n\ny", False), ("c", 6, "1\n2\n\n3", True)]
    assert rows(1) == [("a", 2, "x", True)] and rows(0) == [] and len(rows(100)) == 3


def test_unused_imports(spark):
    """Names in comments and other import lines don't count as used; a name's first import line counts. Nothing is joined."""
    text = "import a, { b as c, d } from 'm';\nimport * as e from 'n';\n  import f from 'o';\nimport 'a';\nc(d); // a f\nx = '// e';"
    files = named(spark, ("a.ts", text), ("b.py", "import a from 'm'\n"), ("c.ts", "a()"), ("d.ts", None))
    found = t.unused_imports(files)
    assert set(tuples(found, "file", "line_no", "name")) == {("a.ts", 1, "a"), ("a.ts", 2, "e"), ("a.ts", 3, "f"), ("b.py", 1, "a")}
    assert set(tuples(t.anomalies(files).filter("rule = 'unused_import'"), "file", "line_no", "suggestion")) == {(f, n, f"remove {x}") for f, n, x in tuples(found, "file", "line_no", "name")}
    assert "Join" not in t.anomalies(files)._jdf.queryExecution().executedPlan().toString()


def broadcasts_nothing(spark, sf, name):
    """The rows of a query that fails if any table is broadcast."""
    import __spark_entry__

    most = "spark.sql.maxBroadcastTableSize"
    was = spark.conf.get(most)
    spark.conf.set(most, "1b")
    try:
        return __spark_entry__.queries()[name](spark, sf).collect()
    finally:
        spark.conf.set(most, was)


def test_unused_imports_broadcast_nothing(spark, sf):
    assert len(broadcasts_nothing(spark, sf, "unused_imports")) == 5


def test_anomaly_lines_broadcast_nothing(spark, sf):
    assert len(broadcasts_nothing(spark, sf, "anomaly_lines")) == 2


def shuffled(spark, df):
    """The rows that a query deals out by key."""
    adaptive = "spark.sql.adaptive.enabled"
    was = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")
    try:
        df = df.select("*")
        df.collect()
        left, n = [df._jdf.queryExecution().executedPlan()], 0
        while left:
            node = left.pop()
            n += node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
            left += [node.children().apply(i) for i in range(node.children().size())]
        return n
    finally:
        spark.conf.set(adaptive, was)


def test_anomalies_deal_out_only_lines_that_a_pattern_finds(spark):
    text = "\n".join(["import a from 'b';", "// x", *["  step(1);"] * 500, "const my_value = 1;", "}"])
    found = t.anomalies(named(spark, ("a.ts", text)))
    assert set(tuples(found, "line_no", "rule")) == {(1, "unused_import"), (503, "snake_variable")}
    assert shuffled(spark, found) == 1


def test_anomalies_look_ahead_by_line_numbers(spark):
    """Lines without a pattern between count: a call is near or far as in the text."""
    gap = lambda first, n, last: (f"{first}{n}.ts", "\n".join([{"then": "p.then(f)", "catch": "} catch (e) {", "chain": "p.then(f)"}[first], *["  step(1);"] * n, last]))
    rows = [gap("then", 4, "q.catch(g)"), gap("then", 5, "q.catch(g)"), gap("catch", 3, "throw e;"), gap("catch", 4, "throw e;"), gap("chain", 8, "q.then(g)"), gap("chain", 9, "q.then(g)")]
    rows += [(f"log{n}.ts", "\n".join(["function deleteAll() {", *["  x += 1;"] * n, "logger.info(x);"])) for n in (18, 19)]
    got = {(f, r) for f, n, r in tuples(t.anomalies(named(spark, *rows)), "file", "line_no", "rule") if n == 1}
    near = {("chain8.ts", "promise_chain")} | {(f"chain{n}.ts", "promise_without_catch") for n in (8, 9)}
    assert got == near | {("then5.ts", "promise_without_catch"), ("catch4.ts", "catch_without_log"), ("log19.ts", "critical_without_log")}


def test_anomalies_lose_no_line_that_a_pattern_finds(spark):
    """Every pattern alone in a line, in comments and beside odd line ends."""
    import re

    finds = ["function f_a", "def f", "try {", "catch (", "x.catch (", "p.then (", "require('logger')", "console.log", "logger.warn", "log.debug", "throw e", "const a_b", "let\ta_b", "var x", "await x", "fetch (u)", "reAuth = (", "WITHDRAW = async (", "function myLogin"]
    texts = [pre + f + post for f in finds for pre in ("", "x ", "// ", "a\r") for post in ("", " // y", "\r", "// z\r")]
    rows = spark.createDataFrame([(s,) for s in texts], "line string")
    kept = {r["line"] for r in rows.filter(F.col("line").rlike(t.TELLING)).collect()}
    assert kept == set(texts)
    assert not re.search(t.TELLING.replace("(?i)", ""), "  step(1);")
