import re
from collections import Counter

from lakeloom.llm import rules
from lakeloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def check(rows, texts):
    for r in rows:
        want = base_counts(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_counts_equal_brute_force(spark, medium):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op7_quality_rules"](spark, medium).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_repeats_by_sorting_and_by_list_agree(spark, monkeypatch):
    texts = [(i, " ".join(f"w{(j * j) % (i + 5)}" for j in range(60))) for i in range(40)] + [(99, "a b c\n\na b c\n a b c")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for few in (0, 3, 1000):
        monkeypatch.setattr(rules, "FEW", few)
        check(rules.quality_rules(df, ["doc_id"]).collect(), dict(texts))


def test_messy_and_empty(messy, empty):
    rows = rules.quality_rules(messy, ["doc_id"]).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert by[2].n_words == by[3].n_words == by[4].n_words == 0 and by[2].base_failed
    assert by[5].n_words == 30_000 and by[5].base_failed
    assert by[6].n_words == 4  # other blanks than 0x20 and 0x09-0x0D are parts of words
    assert rules.quality_rules(empty, ["doc_id"]).count() == 0


def test_native_plan(spark, small):
    plan = QUERIES["op7_quality_rules"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_table_is_compiled(spark):
    df = spark.createDataFrame([(1, 10, 5), (2, 10, 6)], "doc_id long, n_words long, n_symbols long")
    rule = (rules.Rule("few", "n_symbols", "<=", (1, 2), "n_words"),)
    assert [r[0] for r in df.orderBy("doc_id").select(rules.compiled(rule)).collect()] == [True, False]
    assert [r[0] for r in df.select(rules.compiled(())).collect()] == [True, True]


def test_kept_columns_may_have_any_names(messy):
    out = rules.quality_rules(messy, messy.columns)
    assert {"input_n_words", "k", "t", "n_words", "_t", "kept"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert out.count() == 9
