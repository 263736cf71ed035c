"""Best representative of each duplicate group of clauses, by iterative truth discovery.

Groups. Copies share document, container (body, form, a certain annex) and number, whatever the
spelling. A row whose container is not stated (bare number, path missing or cut short) is placed
by truth discovery over kinds of evidence shared with placed rows of the same document and number:
word shingles of five, path labels, title and delivery uid, joined on equal tokens (no pairs are
formed). Container support and the kinds' reliability are estimated alternately. A row without
enough evidence goes to the container its region suggests, or stays apart.

Fields. Each copy votes for its value of each field. Source reliability and value support are
estimated alternately until they settle: a value's support is the sum of its sources' weights, more
for complete and for recent values; a source's reliability is the share of its votes that won, with
``parser_trust`` as prior. Groups with the same voting pattern are folded into one weighted pattern
before the iteration, so it runs over few rows; only the weights (one per trusted parser, all
others share one) come to the driver. The surviving row takes the winning value of each field,
field by field.

Defined results: rows with a null document or number are groups of one; null values get no vote
but survive if all are null; ties go to the more complete, then later value, then the smaller key;
repeated rows are copies; unknown parsers share one weight; empty tables give empty results; extra
columns are ignored. A hot document, number or group is a hot key of equi-joins only, and these are
such that adaptive execution can split it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.operators.skew import join_aggregate
from clausewright.session import cut_lineage

BLANKS = r"[\s\x{00A0}\x{2000}-\x{200B}\x{202F}\x{3000}\x{FEFF}]+"
FIELDS = ("clause_id", "section_path", "document_region", "title", "text")
SHINGLE = 5
MAX_PARSERS = 10_000
BROADCAST_ROWS = 100_000
PATTERN_VALUES = 1_000


def clause_number(clause_id: Column) -> Column:
    """Canonical spelling: lower case without blanks, signs and trailing full stops; decimal commas as stops."""
    s = F.lower(F.regexp_replace(clause_id, BLANKS, ""))
    s = F.regexp_replace(s, r"^(?:paragraph|para\.?|§+|no\.|nr\.|clause|section)+", "")
    s = F.regexp_replace(F.translate(s, ",–—", ".--"), r"[.:;)]+$", "")
    return F.when(s != "", s)


def with_identity(clauses: DataFrame) -> DataFrame:
    """Adds number (within its container), container where stated, and the region in lower case."""
    number = clause_number(F.col("clause_id"))
    head = F.lower(F.coalesce(F.try_element_at("section_path", F.lit(1)), F.lit("")))
    region = F.lower(F.trim(F.coalesce("document_region", F.lit(""))))
    annex_id = F.regexp_extract(number, r"^annex(\d+)(?:$|[/\-.])", 1)
    annex_path = F.regexp_extract(head, r"^annex\s*(\d+)", 1)
    container = (
        F.when(annex_id != "", F.concat(F.lit("annex "), annex_id))
        .when(annex_path != "", F.concat(F.lit("annex "), annex_path))
        .when((region == "front_matter") | head.startswith("front matter") | (number == "front-matter"), "front")
        .when((region == "form") | head.contains("communication form"), "form")
        .when(region == "body", "body")
    )
    within = F.when(annex_id != "", F.regexp_replace(number, r"^annex\d+[/\-.]?", "")).otherwise(number)
    return clauses.withColumns({"number": within, "container": container, "region": region})


KINDS = ("text", "path", "title", "uid")
#: prior weights of the kinds of evidence, in the order of KINDS
KIND_PRIOR = (1.0, 0.8, 0.4, 1.2)


def evidence(rows: DataFrame) -> DataFrame:
    """(clause_key, reg_doc, number, container, kind, token, n): tokens of each kind, distinct per row, and how many the row has of it."""
    words = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
    w = F.col("__w")
    shingles = F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, SHINGLE), " ")))).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
    labels = F.transform("section_path", lambda p: F.xxhash64(F.lower(F.trim(p))))
    single = lambda c: F.when(F.col(c).isNotNull(), F.array(F.xxhash64(F.lower(c))))
    none = F.array().cast("array<bigint>")
    held = [F.array_distinct(F.coalesce(x, none)) for x in (shingles, labels, single("title"), single("uid"))]
    base = rows.withColumn("__w", words).select("clause_key", "reg_doc", "number", "container", *[x.alias(f"t{i}") for i, x in enumerate(held)])

    def kind(i: int) -> Column:
        return F.transform(f"t{i}", lambda x: F.struct(F.lit(i).alias("kind"), x.alias("token"), F.size(f"t{i}").alias("n")))

    tokens = F.concat(*map(kind, range(len(KINDS))))
    return base.select("clause_key", "reg_doc", "number", "container", F.inline(tokens))


def placed_by_evidence(votes_: DataFrame, rounds: int = 10, settle: float = 1e-3) -> DataFrame:
    """(clause_key, found): the container of each row by truth discovery over kinds of evidence.

    ``votes_`` has (clause_key, container, s0..s3): the share of the row's tokens of each kind that the
    container's placed rows hold. A container's support is the weighted sum of these shares; a kind is as
    reliable as its share at the winner is near its best share anywhere. Only four weights reach the driver.
    """
    votes_ = cut_lineage(votes_)
    weights = list(KIND_PRIOR)
    shares = [F.col(f"s{i}") for i in range(len(KINDS))]
    for _ in range(rounds):
        total = sum((s * w for s, w in zip(shares, weights)), F.lit(0.0))
        best = votes_.groupBy("clause_key").agg(F.max_by(F.struct(*[f"s{i}" for i in range(len(KINDS))]), F.struct(total.alias("t"), "container")).alias("w"), *[F.max(f"s{i}").alias(f"m{i}") for i in range(len(KINDS))])
        row = best.agg(*[F.sum(f"w.s{i}").alias(f"a{i}") for i in range(len(KINDS))], *[F.sum(f"m{i}").alias(f"b{i}") for i in range(len(KINDS))]).first()
        fresh = []
        for i, prior in enumerate(KIND_PRIOR):
            share = min(0.98, max(0.02, ((row[f"a{i}"] or 0.0) + 20 * 0.8) / ((row[f"b{i}"] or 0.0) + 20)))
            fresh.append(prior * (0.5 + 0.25 * math.log(share / (1 - share))))
        moved = max(abs(x - y) for x, y in zip(weights, fresh))
        weights = fresh
        if moved < settle:
            break
    total = sum((s * w for s, w in zip(shares, weights)), F.lit(0.0))
    return votes_.groupBy("clause_key").agg(F.max_by("container", F.struct(total.alias("t"), "container")).alias("found"))


def grouped(clauses: DataFrame, least_overlap: float = 0.25) -> DataFrame:
    """(clause_key, group_id): rows with equal ids are copies of one clause."""
    rows = with_identity(clauses.select("clause_key", "reg_doc", "uid", *FIELDS))
    slim = rows.select("clause_key", "reg_doc", "number", "container")
    open_ = F.col("container").isNull() & F.col("number").isNotNull() & F.col("reg_doc").isNotNull()
    unplaced = cut_lineage(rows.filter(open_))
    blocks = cut_lineage(unplaced.select("reg_doc", "number").distinct())
    # texts are shuffled only where the blocks are too many to be sent to every task
    few = F.broadcast(blocks) if blocks.count() <= BROADCAST_ROWS else blocks
    placed = rows.filter(F.col("container").isNotNull()).join(few, ["reg_doc", "number"], "left_semi")
    own = evidence(unplaced).drop("container")
    # copies of one clause hold the same tokens: each counts once per container, so a hot group meets few rows
    known = evidence(placed).select("reg_doc", "number", "container", "kind", "token").distinct()
    shared = own.join(known, ["reg_doc", "number", "kind", "token"]).groupBy("clause_key", "container", "kind", "token").agg(F.max("n").alias("n"))
    per_kind = shared.groupBy("clause_key", "container").agg(*[f for i in range(len(KINDS)) for f in (F.count_if(F.col("kind") == i).alias(f"c{i}"), F.coalesce(F.max(F.when(F.col("kind") == i, F.col("n"))), F.lit(1)).alias(f"n{i}"))])
    lengths = own.filter("kind = 0").groupBy("clause_key").agg(F.max("n").alias("n_text"))
    per_kind = per_kind.join(lengths, "clause_key", "left").withColumns({f"s{i}": F.col(f"c{i}") / F.col(f"n{i}") for i in range(len(KINDS))})
    # enough of the text is shared, or there is too little text to tell, or path and title agree
    enough = (F.col("s0") >= least_overlap) | (F.coalesce("n_text", F.lit(0)) < 4) | (3 * F.col("c1") + 2 * F.col("c2") + 2 * F.col("c3") >= 5)
    best = placed_by_evidence(per_kind.filter(enough).select("clause_key", "container", *[f"s{i}" for i in range(len(KINDS))]))
    # a row whose evidence fits no placed row may only meet its equals, unless no placed body row contradicts that it is one
    bodies = placed.filter("container = 'body'").select("reg_doc", "number").distinct().withColumn("has_body", F.lit(True))
    n_words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))
    alone = unplaced.select("clause_key", n_words.alias("n_words"), F.xxhash64(F.lower(F.regexp_replace(F.coalesce("text", F.col("uid")), r"[^\p{L}\p{N}]+", " "))).cast("string").alias("wording"))
    other = (F.col("region") == "annex") | F.col("has_body") & (F.col("n_words") >= 4)
    default = F.when(other, F.concat(F.lit("? "), F.col("wording"))).otherwise("body")
    placing = join_aggregate(unplaced.select("clause_key", "reg_doc", "number", "region").join(best, "clause_key", "left").join(alone, "clause_key"), bodies, ["reg_doc", "number"], "left").select("clause_key", F.coalesce("found", default).alias("placed_in"))
    out = slim.join(placing, "clause_key", "left").withColumn("container", F.coalesce("container", "placed_in"))
    whole = F.col("reg_doc").isNotNull() & F.col("number").isNotNull()
    return out.select("clause_key", F.when(whole, F.concat_ws("\x1f", "reg_doc", "container", "number")).otherwise(F.concat(F.lit("\x1e"), F.col("clause_key").cast("string"))).alias("group_id"))


def copy_pairs(groups: DataFrame) -> DataFrame:
    """(clause_key_a, clause_key_b), smaller first, of all copies in one group."""
    groups = cut_lineage(groups)
    a, b = groups.select("group_id", F.col("clause_key").alias("clause_key_a")), groups.select("group_id", F.col("clause_key").alias("clause_key_b"))
    return a.join(b, "group_id").filter(F.col("clause_key_a") < F.col("clause_key_b")).select("clause_key_a", "clause_key_b")


def completeness(field: str) -> Column:
    """How much a value says, 0 to 3."""
    if field == "text":
        tidy = F.trim(F.col("text"))
        cut = tidy.rlike(r"(?:…|\.\.\.)\s*$|[^.!?;:)\]>}|*_\d\s]\s*$")
        dirty = tidy.rlike(r"</?[A-Za-z][^<>]*>|\\[A-Za-z]+|\{\{|\$\{|&[a-z]+;|[\x{00AD}¬‐]|-\n")
        return F.when(tidy.isNull() | (tidy == ""), 0).when(cut, 1).when(dirty, 2).otherwise(3)
    if field == "section_path":
        return F.least(F.greatest(F.size("section_path"), F.lit(0)), F.lit(3))
    if field == "document_region":
        r = F.lower(F.trim("document_region"))
        return F.when(r.isNull() | (r == ""), 0).when(r == "unknown", 1).otherwise(3)
    if field == "clause_id":
        return F.when(F.col("clause_id").isNull() | (F.trim("clause_id") == ""), 0).when(F.col("clause_id").rlike(r"(?i)^(?:annex \d+ / )?\d+(?:\.\d+)*$|^annex \d+$|^front-matter$"), 3).otherwise(1)
    return F.when(F.col(field).isNull() | (F.trim(field) == ""), 0).when(F.col(field).rlike(r"(?:…|\.\.\.)\s*$"), 1).otherwise(3)


def votes(clauses: DataFrame, groups: DataFrame, parsers: list[str]) -> DataFrame:
    """One row per (group, field, value): its parsers' vote counts, completeness, recency and the row to take it from."""
    parser = F.coalesce(F.try_element_at(F.create_map(*[x for i, p in enumerate(parsers) for x in (F.lit(p), F.lit(i + 1))]) if parsers else F.create_map().cast("map<string,int>"), F.col("parser_name")), F.lit(0))
    rows = clauses.select("clause_key", "parser_name", "ingested_at", *FIELDS).join(groups, "clause_key")
    size = rows.groupBy("group_id").agg(F.count("*").alias("copies"), F.max("ingested_at").alias("latest")).filter("copies > 1")
    rows = join_aggregate(rows, size, ["group_id"])
    value = {f: F.xxhash64(F.lit(f), F.to_json("section_path") if f == "section_path" else F.regexp_replace(F.lower(F.col(f)), r"\s+", " ")) for f in FIELDS}
    cells = rows.select("group_id", "clause_key", parser.alias("parser"), F.coalesce(F.col("ingested_at") == F.col("latest"), F.lit(False)).cast("int").alias("late"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), value[f].alias("value"), completeness(f).alias("full")) for f in FIELDS])).alias("c")).select("group_id", "clause_key", "parser", "late", "c.*").filter("full > 0")
    per_parser = cells.groupBy("group_id", "field", "value", "parser").agg(F.count("*").alias("n"), F.max("full").alias("full"), F.max("late").alias("late"), F.min("clause_key").alias("clause_key"))
    return per_parser.groupBy("group_id", "field", "value").agg(F.array_sort(F.collect_list(F.struct("parser", "n"))).alias("by"), F.max("full").alias("full"), F.max("late").alias("late"), F.min("clause_key").alias("clause_key"))


def support(by: Column, full: Column, late: Column, weights: list[float]) -> Column:
    """Sum of the voters' weights (repeated votes of one parser count by their logarithm), with bonuses."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    total = F.aggregate(by, F.lit(0.0), lambda a, v: a + F.element_at(w, v["parser"] + 1) * (1 + F.log(v["n"].cast("double"))))
    return total * (0.4 + 0.2 * full) + 0.1 * late


def discover(vote_rows: DataFrame, parsers: list[str], prior: list[float], rounds: int = 12, settle: float = 1e-3) -> list[float]:
    """Weights of the sources (0: unknown parsers) after alternating estimation over voting patterns."""
    candidate = F.struct("full", "late", "by")
    sizes = vote_rows.groupBy("group_id", "field").agg(F.count("*").alias("values")).filter("values > 1")
    few = join_aggregate(vote_rows, sizes.filter(F.col("values") <= PATTERN_VALUES), ["group_id", "field"], "left_semi")
    patterns = cut_lineage(few.groupBy("group_id", "field").agg(F.array_sort(F.collect_list(candidate)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("times")))
    # groups with more values than a pattern may hold are judged row by row
    rest = cut_lineage(join_aggregate(vote_rows, sizes.filter(F.col("values") > PATTERN_VALUES), ["group_id", "field"], "left_semi"))
    weights = list(prior)
    for _ in range(rounds):
        scored = patterns.select("times", F.transform("pattern", lambda c: F.struct(support(c["by"], c["full"], c["late"], weights).alias("s"), c["by"].alias("by"))).alias("p"))
        top = F.array_max(F.transform("p", lambda c: c["s"]))
        each = scored.select("times", F.explode(F.transform("p", lambda c: F.struct((c["s"] >= top).cast("int").alias("won"), c["by"].alias("by")))).alias("c"))
        judged = rest.withColumn("s", support(F.col("by"), F.col("full"), F.col("late"), weights))
        tops = judged.groupBy("group_id", "field").agg(F.max("s").alias("top"))
        single = join_aggregate(judged, tops, ["group_id", "field"]).select(F.lit(1).cast("long").alias("times"), (F.col("s") >= F.col("top")).cast("int").alias("won"), F.inline("by"))
        tally = each.select("times", "c.won", F.inline("c.by")).unionByName(single).groupBy("parser").agg(F.sum(F.col("times") * F.col("n") * F.col("won")).alias("won"), F.sum(F.col("times") * F.col("n")).alias("cast")).collect()
        fresh = list(prior)
        for r in tally:
            share = (r["won"] + 20 * prior[r["parser"]]) / (r["cast"] + 20)
            share = min(0.98, max(0.02, share))
            fresh[r["parser"]] = max(0.05, 0.5 + 0.25 * math.log(share / (1 - share)))
        moved = max(abs(a - b) for a, b in zip(weights, fresh))
        weights = fresh
        if moved < settle:
            break
    return weights


def trusted_parsers(parser_trust: DataFrame) -> tuple[list[str], list[float]]:
    """Parser names and prior weights (index 0: all other parsers)."""
    rows = parser_trust.filter(F.col("parser_name").isNotNull()).groupBy("parser_name").agg(F.max("trust").alias("trust")).orderBy("parser_name").limit(MAX_PARSERS + 1).collect()
    if len(rows) > MAX_PARSERS:
        raise ValueError(f"more than {MAX_PARSERS} parsers")
    most = max([1.0, *(float(r["trust"] or 0) for r in rows)])
    return [r["parser_name"] for r in rows], [0.1, *(0.1 + 0.8 * max(0.0, float(r["trust"] or 0)) / most for r in rows)]


def survivors(clauses: DataFrame, parser_trust: DataFrame) -> DataFrame:
    """One row per group: group_id, copies, and each field's best value; clause_key is the group's smallest."""
    parsers, prior = trusted_parsers(parser_trust)
    groups = cut_lineage(grouped(clauses))
    vote_rows = cut_lineage(votes(clauses, groups, parsers))
    weights = discover(vote_rows, parsers, prior)
    best = vote_rows.groupBy("group_id", "field").agg(F.max_by("clause_key", F.struct(support(F.col("by"), F.col("full"), F.col("late"), weights).alias("s"), "full", "late", (-F.col("clause_key")).alias("k"))).alias("clause_key"))
    wanted = best.groupBy("clause_key", "group_id").agg(F.collect_set("field").alias("wins"))
    chosen = wanted.join(clauses.select("clause_key", *FIELDS), "clause_key").groupBy("group_id").agg(*[F.max(F.when(F.array_contains("wins", f), F.col(f))).alias(f) for f in FIELDS])
    whole = groups.groupBy("group_id").agg(F.min("clause_key").alias("clause_key"), F.count("*").alias("copies"))
    many = whole.filter("copies > 1").join(chosen, "group_id", "left")
    single = whole.filter("copies = 1").join(clauses.select("clause_key", *FIELDS), "clause_key")
    return single.select("clause_key", "group_id", "copies", *FIELDS).unionByName(many.select("clause_key", "group_id", "copies", *FIELDS))
