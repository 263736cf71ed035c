from clausewright.operators import links, providers


class Shaky:
    def __init__(self):
        self.seen = {}

    def answer(self, prompts):
        p = prompts[0]
        self.seen[p] = self.seen.get(p, 0) + 1
        if "never" in p or self.seen[p] == 1:
            raise RuntimeError("no luck")
        return [p.upper()]


def test_one_retry_then_an_error_column(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "never")], "k int, prompt string")
    got = {r.key: (r.answer, r.error) for r in providers.ask(rows, "k", "prompt", Shaky(), partitions=2).collect()}
    assert got == {"1": ("A", None), "2": (None, "RuntimeError: no luck")}


def test_replay(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    got = {r.key: (r.answer, r.error) for r in providers.replay(rows, "k", spark.createDataFrame([("1", "x")], "key string, answer string")).collect()}
    assert got == {"1": ("x", None), "2": (None, "not recorded")}


def test_labels_get_defaults(spark):
    clauses = spark.createDataFrame([("a", False), ("b", False), ("c", False), ("p", True)], "uid string, is_pseudo_clause boolean")
    answers = spark.createDataFrame([("[a]", "obligation", "odd"), ("b", "odd", "binding"), ("ghost", "scope", "none")], "uid string, category string, force string")
    got = {r.uid: (r.category, r.force) for r in providers.checked_labels(answers, clauses).collect()}
    assert got == {"a": ("obligation", "binding"), "b": ("informative", "binding"), "c": ("informative", "none"), "p": ("formatting", "none")}


def test_document_tree(spark):
    clauses = spark.createDataFrame([(1, "d", ["A", "B"]), (2, "d", ["A"]), (3, "d", None), (4, "d", [])], "clause_key long, reg_doc string, section_path array<string>")
    assert {tuple(r) for r in links.structural_links(clauses).collect()} == {("d", "A", "parent_of", "A > B"), ("d", "A > B", "contains", "1"), ("d", "A", "contains", "2")}
