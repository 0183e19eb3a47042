"""Scores over commits, signals, candidates, snapshots and symbols of several repositories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.storage import small

DAY = 86400
#: Commit types in the order of their rules: (type, confidence, patterns over the subject in small letters). Fixed values.
COMMIT_RULES = [
    ("fix", 0.95, [r"^fix[:(\s]", "bug|issue|error|crash|broken|fail"]),
    ("feat", 0.95, [r"^feat[:(\s]", r"^add\s|^new\s|implement|feature"]),
    ("refactor", 0.90, [r"^refactor[:(\s]", r"refact|clean\sup|improve|simplif|reorgani"]),
    ("docs", 0.90, [r"^docs[:(\s]", "document|readme|comment|typo"]),
    ("chore", 0.90, [r"^chore[:(\s]", r"^build[:(\s]|^ci[:(\s]|dep|bump|version|release|merge"]),
]
COMMIT_TYPES = [t for t, _, _ in COMMIT_RULES]
#: Prompt intents in the order of their rules (fixed values).
INTENT_RULES = [
    ("debug", "fix|debug|bug|crash|fail|error|issue|resolve|problem|broken"),
    ("refactor", "refactor|optimize|improve|clean|simplify|quality|performance|restructure"),
    ("docs", "doc|comment|readme|explain|guide|write.*guide|注释|文档"),
]
NON_CODE = "^(天气|weather|翻译|translate|写邮件|email|闲聊|chat|你好|hello|hi)"
#: Error families in the order of their rules: (type, pattern, path pattern, score of a path that matches). Fixed values.
ERROR_RULES = [
    ("null_reference", "TypeError|undefined|null", "types?|model|data|util", 0.7),
    ("syntax", "SyntaxError|parse", None, 0.5),
    ("reference", "ReferenceError|not defined", None, 0.5),
    ("network", "NetworkError|fetch|request", "api|fetch|request|http|client", 0.9),
    ("auth", "AuthError|unauthorized|forbidden", "auth|login|user|session", 0.9),
]
#: Weights of actions, of a correction (an edit after an ignore), and of the shares of a fault score (fixed values).
ACTIONS = {"view": 1.5, "edit": 2.0, "ignore": -0.5}
CORRECTION = 1.5
FAULT = {"chain": 0.40, "history": 0.30, "hotspot": 0.15, "pattern": 0.15}
#: Classes of verbs that start a symbol (fixed values).
VERBS = {"get": ["get", "fetch", "find", "load", "read"], "create": ["create", "add", "new", "insert", "post"], "update": ["update", "edit", "modify", "patch", "put"], "delete": ["delete", "remove", "destroy"]}
CONTRACT_BONUS = {"proto": 0.1, "graphql": 0.08, "openapi": 0.05}


def first_rule(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first rule whose condition holds."""
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), default)


def commit_type(subject: Column) -> Column:
    """struct(type, confidence) of a subject line; chore with 0.70 if no rule holds."""
    low = F.lower(subject)
    pair = lambda t, c: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))
    rules = [(reduce(lambda a, b: a | b, (low.rlike(p) for p in ps)), pair(t, c)) for t, c, ps in COMMIT_RULES]
    return first_rule(rules, pair("chore", 0.70))


def is_bug_fix(subject: Column) -> Column:
    return commit_type(subject)["type"] == "fix"


def intent_type(text: Column) -> Column:
    """debug, refactor, docs or feature; feature for texts without Latin letters."""
    low = F.lower(text)
    return F.when(~F.coalesce(text.rlike("[a-zA-Z]"), F.lit(False)), "feature").otherwise(first_rule([(low.rlike(p), F.lit(t)) for t, p in INTENT_RULES], F.lit("feature")))


def is_code_intent(text: Column) -> Column:
    return intent_type(text) != "docs"


def is_non_code(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?i){NON_CODE}"), F.lit(False))


def error_type(text: Column) -> Column:
    return first_rule([(text.rlike(f"(?i){p}"), F.lit(t)) for t, p, _, _ in ERROR_RULES], F.lit("unknown"))


def error_path_score(kind: Column, path: Column) -> Column:
    return first_rule([((kind == t) & path.rlike(f"(?i){on}"), F.lit(s)) for t, _, on, s in ERROR_RULES if on], F.lit(0.5))


def churn(commits: DataFrame, since: int | None = None) -> DataFrame:
    """file, freq: the commits that touch each file, from a time on."""
    rows = commits if since is None else commits.filter(F.col("ts") >= since)
    return rows.groupBy("file").agg(F.count("*").alias("freq"))


def file_age(commits: DataFrame, now: int) -> DataFrame:
    """file, age_days: whole days since the newest commit, 0 at least."""
    return commits.groupBy("file").agg(F.greatest(F.floor((F.lit(now) - F.max("ts")) / DAY), F.lit(0)).cast("long").alias("age_days"))


def hotspots(commits: DataFrame, lines: DataFrame, *, mode: str = "default", now: int = 0, bug_weight: float = 1.0, weights: tuple[float, float, float, float] = (0.4, 0.2, 0.2, 0.2), coupling: DataFrame | None = None, top: int = 20) -> DataFrame:
    """The hottest files: file, freq, lines, score.

    default: freq times lines. bug: that, raised by the share of bug fixes times bug_weight, rounded. weighted: churn, lines, age and
    coupling, each over its maximum, weighted; 1.2 times for files changed within 30 days, 6 decimals. lines: file, lines.
    """
    f = commits.groupBy("file").agg(F.count("*").alias("freq"), F.count_if(is_bug_fix(F.col("subject"))).alias("bugs"), F.max("ts").alias("last"))
    f = f.join(lines, "file", "left").withColumn("lines", F.coalesce("lines", F.lit(1)))
    if mode == "default":
        score = (F.col("freq") * F.col("lines")).cast("double")
    elif mode == "bug":
        score = F.round(F.col("freq") * F.col("lines") * (1 + bug_weight * F.col("bugs") / F.col("freq")), 0)
    elif mode == "weighted":
        f = f.join(coupling, "file", "left") if coupling is not None else f.withColumn("coupling", F.lit(0))
        f = f.withColumn("coupling", F.coalesce("coupling", F.lit(0)))
        most = f.agg(*(F.max(c).alias(f"_{c}") for c in ("freq", "lines", "bugs", "coupling")))
        f = f.join(F.broadcast(most))
        share = lambda c: F.when(F.col(f"_{c}") > 0, F.col(c) / F.col(f"_{c}")).otherwise(0.0)
        total = sum((w * share(c) for w, c in zip(weights, ("freq", "lines", "bugs", "coupling"), strict=True)), F.lit(0.0))
        score = F.round(total * F.when(F.floor((F.lit(now) - F.col("last")) / DAY) <= 30, 1.2).otherwise(1.0), 6)
    else:
        raise ValueError("mode is default, bug or weighted")
    return f.select("file", "freq", "lines", score.alias("score")).orderBy(F.desc("score"), "file").limit(top)


def commit_histogram(commits: DataFrame) -> DataFrame:
    """Per file: commits of each type (zeros included), n_commits, n_fixes, bug_ratio (4 decimals), last_fix, fixes (sorted shas)."""
    c = commits.withColumn("_t", commit_type(F.col("subject"))["type"])
    fix = F.col("_t") == "fix"
    counts = [F.count_if(F.col("_t") == t).alias(f"n_{t}") for t in COMMIT_TYPES]
    return c.groupBy("file").agg(F.count("*").alias("n_commits"), *counts, F.round(F.avg(fix.cast("double")), 4).alias("bug_ratio"), F.max(F.when(fix, F.col("ts"))).alias("last_fix"), F.array_join(F.array_sort(F.collect_set(F.when(fix, F.col("sha")))), ",").alias("fixes"))


def preferences(signals: DataFrame, now: int, top: int | None = 10, prefix: str | None = None) -> DataFrame:
    """Per symbol_id: symbol, frequency, score (6 decimals). An action weighs its weight over 1 + its age in whole days; a symbol edited
    at or after its first ignore gets a correction."""
    s = signals if prefix is None else signals.filter(F.col("symbol_id").startswith(prefix))
    weight = F.coalesce(*(F.when(F.col("action") == a, F.lit(w)) for a, w in ACTIONS.items()), F.lit(1.0))
    age = F.greatest(F.floor((F.lit(now) - F.col("timestamp")) / DAY), F.lit(0))
    at = lambda a, f: f(F.when(F.col("action") == a, F.col("timestamp")))
    out = s.groupBy("symbol_id").agg(F.min("symbol").alias("symbol"), F.count("*").alias("frequency"), F.sum(weight / (1 + age)).alias("_s"), at("ignore", F.min).alias("_i"), at("edit", F.max).alias("_e"))
    score = F.round(F.col("_s") + F.when(F.col("_e") >= F.col("_i"), CORRECTION).otherwise(0.0), 6)
    out = out.select("symbol_id", "symbol", "frequency", score.alias("score"))
    return out if top is None else out.orderBy(F.desc("score"), "symbol_id").limit(top)


def linear_decay(signals: DataFrame, now: int, days: float = 90.0) -> DataFrame:
    """file_path, score: weights that fall to nothing over `days`, summed, 6 decimals."""
    age = (F.lit(now) - F.col("timestamp")) / DAY
    return signals.groupBy("file_path").agg(F.round(F.sum(F.col("weight") * F.greatest(F.lit(0.0), 1 - age / days)), 6).alias("score"))


def retained(signals: DataFrame, now: int, days: int = 90, most: int | None = None) -> DataFrame:
    """Signals no older than `days`; of these the newest `most`."""
    out = signals.filter(F.col("timestamp") >= now - days * DAY)
    return out if most is None else out.orderBy(F.desc("timestamp"), "symbol_id").limit(most)


def signal_boost(candidates: DataFrame, signals: DataFrame) -> DataFrame:
    """Add to each candidate's relevance_score the weights of signals whose symbol_id is in its file (file or file::symbol)."""
    own = signals.groupBy(F.substring_index("symbol_id", "::", 1).alias("file_path")).agg(F.sum("weight").alias("boost"))
    out = candidates.join(own, "file_path", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    return out.withColumn("relevance_score", F.round(F.col("relevance_score") + F.col("boost"), 6))


def fault_locations(candidates: DataFrame, history: DataFrame, heat: DataFrame, message: str, top: int = 5) -> DataFrame:
    """The files most likely at fault: file_path, score (4 decimals) and its parts.

    candidates: file_path, chain (0 to 1), line (may be null). history: file_path, n_fixes. heat: file_path, score. History and heat
    count over their maximum, 1 at most; missing ones are 0. A known line gets a range from 5 lines above to 15 below.
    """
    c = candidates.groupBy("file_path").agg(F.max("chain").alias("chain"), F.min("line").alias("line"))
    most = lambda df, x, n: df.join(F.broadcast(df.agg(F.max(x).alias("_m")))).select("file_path", F.least(F.lit(1.0), F.when(F.col("_m") > 0, F.col(x) / F.col("_m")).otherwise(0.0)).alias(n))
    c = c.join(most(history, "n_fixes", "history"), "file_path", "left").join(most(heat, "score", "hotspot"), "file_path", "left")
    c = c.withColumn("pattern", error_path_score(error_type(F.lit(message)), F.col("file_path")))
    for part in ("chain", "history", "hotspot"):
        c = c.withColumn(part, F.coalesce(part, F.lit(0.0)))
    c = c.withColumn("score", F.round(sum((w * F.col(p) for p, w in FAULT.items()), F.lit(0.0)), 4))
    c = c.withColumn("from_line", F.greatest(F.col("line") - 5, F.lit(1))).withColumn("to_line", F.col("line") + 15)
    return c.orderBy(F.desc("score"), "file_path").limit(top)


def impact_boost(candidates: DataFrame, impact: DataFrame) -> DataFrame:
    """Scores raised by up to a fifth with the number of affected nodes (100 count in full). impact: file_path, n_affected."""
    out = candidates.join(impact, "file_path", "left")
    return out.withColumn("score", F.round(F.col("score") * (1 + 0.2 * F.least(F.coalesce("n_affected", F.lit(0)) / 100, F.lit(1.0))), 4))


def chain_scores(depth: Column) -> Column:
    """1 for a named file, a fifth less for each step along the call chain, 0 at least."""
    return F.greatest(F.lit(0.0), 1 - 0.2 * depth)


# ---------------------------------------------------------------- symbols of several repositories


def verb_class(name: Column) -> Column:
    low = F.lower(name)
    return first_rule([(low.rlike("^(" + "|".join(v) + ")"), F.lit(k)) for k, v in VERBS.items()], F.lit(""))


def base_name(name: Column) -> Column:
    """The name in small letters without the verb it starts with."""
    return F.regexp_replace(F.lower(name), "^(" + "|".join(v for vs in VERBS.values() for v in vs) + ")", "")


def nouns(name: Column) -> Column:
    """The words of three letters or more in a CamelCase or snake_case name, in small letters, without verbs."""
    parts = F.regexp_extract_all(name, F.lit("([A-Z]?[a-z]+|[A-Z]+)"), F.lit(1))
    verbs = [v for vs in VERBS.values() for v in vs]
    return F.filter(F.transform(parts, F.lower), lambda w: (F.length(w) >= 3) & ~w.isin(verbs))


def shared_letters(a: Column, b: Column) -> Column:
    """Letters of a that can be paired with ones of b, over the longer one's length."""
    used = F.aggregate(F.split(a, ""), F.struct(b.alias("rest"), F.lit(0).alias("n")), lambda s, c: F.when((c != "") & (F.instr(s["rest"], c) > 0), F.struct(F.concat(F.substring(s["rest"], F.lit(1), F.instr(s["rest"], c) - 1), F.substring(s["rest"], F.instr(s["rest"], c) + 1, F.length(s["rest"]))).alias("rest"), (s["n"] + 1).alias("n"))).otherwise(s))
    return used["n"] / F.greatest(F.length(a), F.length(b), F.lit(1))


def name_match(a: Column, b: Column) -> Column:
    """1 for equal names (letter case aside), .7 if one starts the other, also without their verbs, .4 if over half of the letters are shared."""
    x, y, p, q = F.lower(a), F.lower(b), base_name(a), base_name(b)
    starts = x.startswith(y) | y.startswith(x) | ((p != "") & (q != "") & (p.startswith(q) | q.startswith(p)))
    return F.when(x == y, 1.0).when(starts, 0.7).when(shared_letters(x, y) > 0.5, 0.4).otherwise(0.0)


def signature_similarity(a: Column, b: Column) -> Column:
    """.6 for verbs of one class or a common noun, else .5."""
    same = (verb_class(a) != "") & (verb_class(a) == verb_class(b))
    return F.when(same | F.arrays_overlap(nouns(a), nouns(b)), 0.6).otherwise(0.5)


#: Characters from rare to frequent in names: which ones of a name are its keys depends on it, which pairs are found doesn't.
RARE_FIRST = "0123456789_$qzxjkvwybhgfpmudcslnoiatre"


def prefix_keys(name: Column, other: bool) -> Column:
    """The keys of a name under which it meets those that it starts, or that start it: itself and its base name whole, or (other) all
    their beginnings."""
    def of(kind: str, text: Column) -> Column:
        if not other:
            return F.array(F.concat(F.lit(kind), text))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda n: F.concat(F.lit(kind), F.substring(text, F.lit(1), n)))

    return F.filter(F.array_distinct(F.concat(of("n", F.lower(name)), of("b", base_name(name)))), lambda k: F.length(k) > 1)


def letter_keys(name: Column) -> Column:
    """The keys of a name under which it meets all that share over half of the longer one's letters.

    A name's letters are numbered (the second e is another one than the first) and put in an order that is the same for all names.
    Names that share over half share one of the first ceil(n / 2) of each.
    """
    low = F.lower(name)
    place = lambda c: F.lpad(F.instr(F.lit(RARE_FIRST), c).cast("string"), 3, "0")
    letters = F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.struct(F.substring(low, i, F.lit(1)).alias("c"), i.alias("i")))
    before = lambda x: F.size(F.filter(letters, lambda y: (y["c"] == x["c"]) & (y["i"] < x["i"])))
    ordered = F.array_sort(F.transform(letters, lambda x: F.concat(place(x["c"]), x["c"], before(x).cast("string"))))
    return F.when(F.length(low) > 0, F.slice(ordered, F.lit(1), F.ceil(F.length(low) / 2).cast("int"))).otherwise(F.array().cast("array<string>"))


def virtual_edges(local: DataFrame, remote: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Edges between like-named symbols of different repositories, with confidence and level.

    local: repo, symbol. remote: repo, symbol, contract_type. Only names that can reach the least confidence are compared: above .43
    one has to start the other, with or without its verb, so that a whole name meets the beginnings of others; up to it, names that
    share over half of their letters count too, and meet by their rarest letters.
    """
    x = local.select(F.col("repo").alias("source_repo"), F.col("symbol").alias("source_symbol")).distinct()
    y = remote.select(F.col("repo").alias("target_repo"), F.col("symbol").alias("target_symbol"), "contract_type").distinct()
    met = [(prefix_keys(F.col("source_symbol"), False), prefix_keys(F.col("target_symbol"), True)), (prefix_keys(F.col("source_symbol"), True), prefix_keys(F.col("target_symbol"), False))]
    if min_confidence <= 0.43:
        met.append((letter_keys(F.col("source_symbol")), letter_keys(F.col("target_symbol"))))
    pairs = None
    for kx, ky in met:
        found = x.withColumn("_k", F.explode(kx)).join(y.withColumn("_k", F.explode(ky)), "_k").filter("source_repo <> target_repo").drop("_k")
        pairs = found if pairs is None else pairs.unionByName(found)
    pairs = pairs.distinct()
    a, b = F.col("source_symbol"), F.col("target_symbol")
    bonus = F.coalesce(*(F.when(F.col("contract_type") == t, F.lit(v)) for t, v in CONTRACT_BONUS.items()), F.lit(0.0))
    out = pairs.withColumn("exact_match", name_match(a, b)).filter("exact_match > 0").withColumn("signature_similarity", signature_similarity(a, b)).withColumn("contract_bonus", bonus)
    out = out.withColumn("confidence", F.round(0.6 * F.col("exact_match") + 0.3 * F.col("signature_similarity") + 0.1 * F.col("contract_bonus"), 4)).filter(F.col("confidence") >= min_confidence)
    level = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") < 0.5, "low").otherwise("medium")
    return out.withColumn("confidence_level", level)


def search_edges(edges: DataFrame, symbol: str, min_confidence: float = 0.0) -> DataFrame:
    """Virtual edges an end of which contains a text (letter case aside), the surest first."""
    low = symbol.lower()
    hit = F.lower("source_symbol").contains(low) | F.lower("target_symbol").contains(low)
    return edges.filter(hit & (F.col("confidence") >= min_confidence)).orderBy(F.desc("confidence"), "source_repo", "source_symbol", "target_repo", "target_symbol")


def federation_totals(repositories: DataFrame) -> DataFrame:
    """Repositories, contracts and symbols of an index (repositories with contracts with symbols)."""
    contracts = F.coalesce(F.col("contracts"), F.array())
    return repositories.agg(F.count("*").alias("repositories"), F.sum(F.size(contracts)).alias("contracts"), F.sum(F.aggregate(F.transform(contracts, lambda c: F.size(c["symbols"])), F.lit(0), lambda a, b: a + b)).alias("symbols"))


def search_contracts(repositories: DataFrame, text: str) -> DataFrame:
    """repo, path, type, symbol: symbols that contain a text, letter case aside."""
    c = repositories.select(F.col("name").alias("repo"), F.explode("contracts").alias("c")).select("repo", "c.path", "c.type", F.explode("c.symbols").alias("symbol"))
    return c.filter(F.lower("symbol").contains(text.lower()))


def list_contracts(repositories: DataFrame, repo: str | None = None) -> DataFrame:
    r = repositories if repo is None else repositories.filter(F.col("name") == repo)
    return r.select(F.col("name").alias("repo"), F.explode("contracts").alias("c")).select("repo", "c.path", "c.type", F.size("c.symbols").alias("n_symbols"))


# ---------------------------------------------------------------- patterns, drift


def pattern_decay(patterns: DataFrame, now: int, rate: float = 0.95, least: float = 0.3, most_days: int = 31) -> DataFrame:
    """Patterns of at least the least confidence, decayed by the days since last_confirmed (seconds), 4 decimals."""
    days = F.least(F.greatest(F.floor((F.lit(now) - F.col("last_confirmed")) / DAY), F.lit(0)), F.lit(most_days))
    return patterns.filter(F.col("confidence") >= least).withColumn("confidence", F.round(F.col("confidence") * F.pow(F.lit(rate), days), 4))


def frequency_decay(frequency: Column, days: Column, rate: float = 0.9) -> Column:
    return frequency * F.pow(F.lit(rate), days)


def pattern_confidence(count: Column, least: int) -> Column:
    """Full from three times the least number on; below the least, its share."""
    return F.when(count >= least, F.least(F.lit(1.0), count / (3.0 * least))).otherwise(count / float(least))


def merge_patterns(patterns: DataFrame) -> DataFrame:
    """One row per pattern_id: that of the last source (source_order)."""
    return patterns.groupBy("pattern_id").agg(F.max_by(F.struct("*"), F.col("source_order")).alias("r")).select("r.*")


def snapshot_drift(base: DataFrame, now: DataFrame, base_files: DataFrame, now_files: DataFrame) -> DataFrame:
    """Drift between two one-row snapshots: score, level and what adds to it.

    Snapshots: total_coupling, dependency_violations, boundary_clarity, cyclic_dependencies. Files: path, coupling.
    """
    b = base.select(*(F.col(c).alias(f"b_{c}") for c in ("total_coupling", "dependency_violations", "boundary_clarity", "cyclic_dependencies")))
    hot = now_files.join(base_files.select("path", F.col("coupling").alias("_old")), "path").filter(F.col("coupling") - F.col("_old") >= 10)
    out = now.join(b).join(hot.agg(F.count("*").alias("hot_files")))
    percent = F.round(F.when(F.col("b_total_coupling") > 0, 100 * (F.col("total_coupling") - F.col("b_total_coupling")) / F.col("b_total_coupling")).otherwise(0.0), 2)
    parts = {
        "coupling": F.when(percent >= 10, 15).otherwise(0),
        "violations": F.when(F.col("dependency_violations") > F.col("b_dependency_violations"), 10).otherwise(0),
        "blur": F.when(F.round(F.col("b_boundary_clarity") - F.col("boundary_clarity"), 6) >= 0.10, 10).otherwise(0),
        "cycles": F.when(F.col("cyclic_dependencies") > F.col("b_cyclic_dependencies"), 10).otherwise(0),
        "hot": 5 * F.col("hot_files"),
    }
    out = out.select(percent.alias("coupling_percent"), *(v.cast("long").alias(k) for k, v in parts.items()))
    out = out.withColumn("score", sum((F.col(k) for k in parts), F.lit(0)))
    return out.withColumn("level", F.when(F.col("score") >= 40, "high").when(F.col("score") >= 20, "medium").otherwise("low"))


def component_drift(planned: DataFrame, found: DataFrame, planned_deps: DataFrame, found_deps: DataFrame) -> DataFrame:
    """Added, removed and moved components (path) and added dependencies (source, target): counts, score and level."""
    base = F.element_at(F.split("path", "/"), -1)
    p, f = planned.select("path", base.alias("base")).distinct(), found.select("path", base.alias("base")).distinct()
    added, removed = f.join(p, "path", "left_anti"), p.join(f, "path", "left_anti")
    moved = added.join(removed.select("base"), "base", "left_semi")
    deps = found_deps.select("source", "target").distinct().join(planned_deps.select("source", "target"), ["source", "target"], "left_anti")
    n = lambda df, c: df.agg(F.count("*").alias(c))
    out = n(added.join(moved.select("path"), "path", "left_anti"), "added").join(n(removed.join(moved.select("base"), "base", "left_anti"), "removed")).join(n(moved, "moved")).join(n(deps, "new_dependencies"))
    out = out.withColumn("score", 15 * F.col("added") + 20 * F.col("removed") + 10 * F.col("moved") + 5 * F.col("new_dependencies"))
    return out.withColumn("level", F.when(F.col("score") >= 50, "high").when(F.col("score") >= 20, "medium").otherwise("low"))


def trend(snapshots: DataFrame, metric: str) -> DataFrame:
    """First and last value of a metric by timestamp, and whether it rose, fell or stayed."""
    out = snapshots.agg(F.min_by(metric, "timestamp").alias("first"), F.max_by(metric, "timestamp").alias("last"))
    return out.withColumn("trend", F.when(F.col("last") > F.col("first"), "increasing").when(F.col("last") < F.col("first"), "decreasing").otherwise("stable"))


def snapshot_steps(snapshots: DataFrame, metric: str, by: str) -> DataFrame:
    """Each snapshot's metric with the one before it in its series."""
    w = Window.partitionBy(by).orderBy("timestamp")
    return snapshots.withColumn("prior", F.lag(metric).over(w)).withColumn("change", F.col(metric) - F.col("prior"))


def tree_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed between two flattened trees (id, type, name, start_line, end_line, child_count): key, status, type, name.

    Named nodes meet by type and name, others by id; the last of equal keys counts. A node is modified if its extent in lines or
    its number of children differs.
    """
    def side(t: DataFrame, p: str) -> DataFrame:
        key = F.when(F.col("name").isNotNull() & (F.col("name") != ""), F.concat_ws(":", "type", "name")).otherwise(F.col("id"))
        mark = F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "child_count")
        return t.groupBy(key.alias("key")).agg(F.max_by(F.struct("type", "name", mark.alias("mark")), F.struct("start_line", "id")).alias(p))

    both = side(old, "o").join(side(new, "n"), "key", "full_outer")
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o.mark") != F.col("n.mark"), "modified").otherwise("unchanged")
    return both.select("key", status.alias("status"), F.coalesce("n.type", "o.type").alias("type"), F.coalesce("n.name", "o.name").alias("name"))


def entropy(rows: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Shannon entropy in bits of the weights' shares within each group, 6 decimals."""
    w = Window.partitionBy(*by)
    p = F.col(weight) / F.sum(weight).over(w)
    return rows.filter(F.col(weight) > 0).withColumn("_p", p).groupBy(*by).agg(F.round(-F.sum(F.col("_p") * F.log2("_p")), 6).alias("entropy"))


def index_decision(last: Column, newest: Column, changed: Column, total: Column, version_ok: Column, cache_ok: Column, most_changed: int = 10) -> Column:
    """What an indexer should do: SKIP, INCREMENTAL, or FULL_REBUILD with its reason."""
    return F.when(last.isNull(), "FULL_REBUILD:no_index").when(~version_ok, "FULL_REBUILD:version").when(~cache_ok, "FULL_REBUILD:cache").when(newest <= last, "SKIP").when(changed > most_changed, "FULL_REBUILD:many_files").otherwise("INCREMENTAL")

