"""op 6: counts against a plain count, verdicts against the threshold table."""
import collections
import re

from webloom.llm import quality_rules as Q

PROSE = "The cat and the dog went to the old house of my friend, and it was a good day for them. "


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def test_counts_and_odd_rows(docs_of, long_text):
    texts = [None, "", " \t\n", "one", PROSE, PROSE * 3, "a b c d e a b c d e f", "a b c\x1cd \x85 e", "x\n\nx\n x\ny\ny",
             "a a a a a a a a", "### $$$ ||| text of the day and more of it & so on < > %", "😀 é\nß\n😀 é", long_text]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, PROSE), (None, PROSE)]
    got = [tuple(r) for r in Q.quality_rules(docs_of(rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()]
    assert sorted(got, key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_verdicts(docs_of):
    table = "| a | b |\n" * 30
    rows = [(1, PROSE * 2 + "More of the same day is told here, and that was all for us."), (2, PROSE), (3, table), (4, "too short"),
            (5, " ".join(f"zz{i}qq" for i in range(60))), (6, None)]
    out = {r.doc_id: r for r in Q.quality_rules(docs_of(rows)).collect()}
    assert out[2].kept and not out[2].base_failed and out[2].failed_rules == []
    assert out[3].base_failed and "symbol_ratio" in out[3].failed_rules and not out[3].kept
    assert out[4].base_failed and not out[4].kept and out[6].base_failed
    assert out[5].failed_rules == ["stop_word_ratio"] and not out[5].kept and not out[5].base_failed
    assert out[1].base_failed == (100 * out[1].n_repeat_words > 20 * out[1].n_words)


def test_own_thresholds_and_empty_table(docs_of):
    rules = (("word_count", "CAST(n_words AS DOUBLE)", None, 3),)
    out = Q.quality_rules(docs_of([(1, PROSE)]), rules=rules).first()
    assert out.failed_rules == ["word_count"]
    assert Q.quality_rules(docs_of([])).count() == 0


def test_main_path_is_native(docs_of):
    plan = Q.quality_rules(docs_of([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Exchange|Join", plan)
