"""Golden cases for the data-driven rule grader."""

from __future__ import annotations

from quire.operators.grading import grade
from quire.sources import literals as L

SCHEMA = "conv_id BIGINT, turn BIGINT, model STRING, prompt_id BIGINT, test_ord INT, prompt STRING, text STRING"

# test_ord: 0 FizzBuzz, 1 Binary Search, 2 Merge Sort, 7 SQL Parser/Decorator,
#           8 Math, 9 Logic, 11 Big-O, 12 CAP, 13 Python ref
CASES = [
    # (id, test_ord, text, expected ok per rule set {full_text, prefix50, prefix100_strip})
    (1, 0, "def fizzbuzz(n):\n    return ['Fizz', 'Buzz']", dict(full_text=True, prefix50=True, prefix100_strip=True)),
    (2, 0, "def fizzbuzz(n): return 'Fizz'", dict(full_text=False, prefix50=False, prefix100_strip=False)),
    (3, 1, "def binary_search(a, t):\n    lo, hi = 0, len(a)", dict(full_text=True, prefix50=True, prefix100_strip=True)),
    (4, 2, "def merge_sort(a): return MERGE(a)", dict(full_text=True, prefix50=True, prefix100_strip=True)),
    (5, 7, "def parse_select(sql): return {'columns': []}", dict(full_text=True, prefix50=False, prefix100_strip=False)),
    (6, 7, "def retry(f):\n    for attempt in range(3): pass", dict(full_text=False, prefix50=True, prefix100_strip=True)),
    (7, 8, "You spend 190 dollars", dict(full_text=True, prefix50=True, prefix100_strip=True)),        # '19' in '190'
    (8, 9, "I know the answer is yes", dict(full_text=True, prefix50=True, prefix100_strip=True)),     # 'no' in 'know'
    (9, 9, "Yes. " + "x" * 60 + " no", dict(full_text=True, prefix50=False, prefix100_strip=True)),  # 'no' at 66
    (10, 9, "Yes. " + "x" * 110 + " no", dict(full_text=True, prefix50=False, prefix100_strip=False)),
    (11, 11, "O(LOG N)", dict(full_text=True, prefix50=True, prefix100_strip=True)),
    (12, 12, "<think>no way</think>\n Yes, both.", dict(full_text=True, prefix50=True, prefix100_strip=False)),
    (13, 12, "hmm</think> Yes, both.", dict(full_text=False, prefix50=False, prefix100_strip=False)),  # orphan close kept
    (14, 13, "It prints 14", dict(full_text=True, prefix50=True, prefix100_strip=True)),               # '4' in '14'
]


def test_golden_verdicts(spark):
    rows = [(cid, 1, "A", cid, ordv, "p", text) for cid, ordv, text, _ in CASES]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["conv_id"], r["rule_set"]): r["ok"]
           for r in grade(df, L.tests_df(spark)).select("conv_id", "rule_set", "ok").collect()}
    for cid, _ordv, text, expected in CASES:
        for rs, ok in expected.items():
            assert got[(cid, rs)] == ok, (cid, rs, text)


def test_rule_sets_have_fourteen_tests():
    for name, *_ in L.RULE_SETS:
        tests = L.rule_set_tests(name)
        assert len(tests) == 14
        assert [t[1] for t in tests].count("coding") == 8
