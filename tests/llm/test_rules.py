"""The rule cascade against a plain computation."""

import itertools
import re

from shelfwise.llm import quality_rules
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    *cases.TEXTS,
    "a b c d e f g h " * 2 + "i j",
    "a b c d e f g h i a b c d e f g h i j k l",
    "w " * 9,
    "w " * 8,
    "p q r s t u v w x p q r s t u v w y p q r s t u v w",
    "### *** a|b <c> 100% & $ " * 5 + cases.SENTENCE,
]


def test_measures(spark):
    rows = quality_rules.apply_rules(cases.documents(spark, TEXTS), estimates=even()).collect()
    for r in rows:
        want = plain(TEXTS[r["doc_id"]])
        assert tuple(r[m] for m in quality_rules.SHOWN) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def even():
    return [{"name": r.name, "cost": 1.0, "rejected": 0.0} for r in quality_rules.RULES]


def test_order_changes_no_verdict(spark):
    docs = cases.documents(spark, TEXTS + ["SHOUT " + cases.SENTENCE.upper(), "12 34 56 78 " * 3 + cases.SENTENCE[:20] * 1, "a1 " * 40])
    verdicts = set()
    for order in itertools.islice(itertools.permutations(quality_rules.RULES), 0, 720, 300):
        estimates = [{"name": r.name, "cost": 1.0, "rejected": 1.0 / (1 + i)} for i, r in enumerate(order)]
        assert quality_rules.ordered(quality_rules.RULES, estimates) == list(order)
        rows = quality_rules.apply_rules(docs, estimates=estimates).select("doc_id", "kept").collect()
        verdicts.add(tuple(sorted((r["doc_id"], r["kept"]) for r in rows)))
    assert len(verdicts) == 1


def test_estimates_come_from_the_sample(spark):
    docs = cases.documents(spark, [cases.SENTENCE] * 30 + [cases.SENTENCE.upper()] * 10)
    found = {e["name"]: e for e in quality_rules.estimate(docs)}
    assert set(found) == {r.name for r in quality_rules.RULES}
    assert found["shouting"]["rejected"] == 0.25 and found["symbols"]["rejected"] == 0
    assert all(e["cost"] > 0 for e in found.values())
    assert quality_rules.ordered(quality_rules.RULES, list(found.values()))[0].name == "shouting"


def test_clean_text_stays_and_junk_goes(spark):
    clean = " ".join(cases.SENTENCE.split() * 1) + ". " + "many other words follow here so that nothing is said twice at all in it"
    shout = clean.upper()
    rows = quality_rules.apply_rules(cases.documents(spark, [clean, shout, clean.replace(" ", "### ")]), estimates=even()).collect()
    assert [r["kept"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [True, False, False]


def test_odd_rows_and_empty_table(spark):
    rows = quality_rules.apply_rules(cases.with_odd_ids(spark)).collect()
    assert len(rows) == len(cases.TEXTS) + 2
    assert quality_rules.apply_rules(cases.documents(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = quality_rules.apply_rules(cases.documents(spark), estimates=even())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
