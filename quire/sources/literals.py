"""Small literal relations: rule catalog, filler sentences, context sizes, codebooks.

Every relation here has a fixed, proven size bound (tens of rows), so joining
against it with ``broadcast`` is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the evaluated behaviour, kept verbatim and in order.
# ---------------------------------------------------------------------------

# Coding checks (conjunctive normal form: every clause must hold, any needle in
# a clause suffices).  (test, [clause, ...]); a clause is [(needle, ignore_case)].
CODING_CHECKS = [
    ("FizzBuzz", [[("def fizzbuzz", False)], [("Fizz", False)], [("Buzz", False)]]),
    ("Binary Search", [[("def binary_search", False)],
                       [("mid", False), ("lo", False), ("low", False)]]),
    ("Merge Sort", [[("def merge_sort", False)], [("merge", True)]]),
    ("LRU Cache", [[("class LRU", False)], [("get", False)], [("put", False)]]),
    ("Dijkstra", [[("def dijkstra", False)], [("heapq", False)]]),
    ("Tree Traversal", [[("inorder", False)], [("preorder", False)], [("postorder", False)]]),
    ("Async Fetch", [[("async", False)], [("aiohttp", False), ("asyncio", False)]]),
]
SQL_PARSER_CHECK = ("SQL Parser", [[("def parse_select", False)],
                                   [("columns", False), ("table", False)]])
DECORATOR_CHECK = ("Decorator", [[("def retry", False)],
                                 [("attempt", False), ("tries", False), ("except", False)]])

# Reasoning checks; "prefix" marks the clause whose window depends on the rule set.
REASONING_CHECKS_FULL_NAMES = ["Math word problem", "Logic puzzle", "Sequence",
                               "Big-O analysis", "Systems reasoning", "Code analysis"]
REASONING_CHECKS_SHORT_NAMES = ["Math", "Logic", "Sequence", "Big-O", "CAP", "Python ref"]
REASONING_CLAUSES = [
    [[("19", False, False)]],
    [[("no", True, True)]],
    [[("42", False, False)]],
    [[("log", True, False)], [("n", True, False)]],
    [[("no", True, True)]],
    [[("4", False, False)]],
]

# Rule sets: (name, prefix window for the "no" checks (None = whole text),
#             eighth coding test, strip thinking before the check)
RULE_SETS = [
    ("full_text", None, SQL_PARSER_CHECK, False, REASONING_CHECKS_FULL_NAMES),
    ("prefix50", 50, DECORATOR_CHECK, False, REASONING_CHECKS_SHORT_NAMES),
    ("prefix100_strip", 100, DECORATOR_CHECK, True, REASONING_CHECKS_SHORT_NAMES),
]

FILLER_SENTENCES = [
    "The history of computing is filled with fascinating developments and innovations.",
    "Many programming languages have been created over the decades, each with unique features.",
    "Software engineering practices continue to evolve as technology advances.",
    "Database systems form the backbone of most modern applications.",
    "Network protocols enable communication between computers around the world.",
    "Operating systems manage hardware resources and provide abstractions for applications.",
    "Cryptography plays a crucial role in securing digital communications.",
    "Machine learning has transformed many fields including computer vision and natural language processing.",
    "Cloud computing provides scalable infrastructure for modern applications.",
    "Version control systems help teams collaborate on software projects effectively.",
]
CONTEXT_SIZES = [8192, 32768, 65536, 128000]
HAYSTACK_QUESTION_HEAD = ("Read the following text carefully and find the secret password "
                          "mentioned somewhere in it.\n\n")
HAYSTACK_QUESTION_TAIL = ("\n\nWhat is the secret password for the treasure vault? "
                          "Answer with just the password.")

CHAT_USER_OPEN = "<|im_start|>user\n"
CHAT_END = "<|im_end|>"
CHAT_ASSISTANT_OPEN = "<|im_start|>assistant\n"

# Sampling / training constants.
SHUFFLE_SEED = 42
TRAIN_RATIO = 0.85
MIN_TEMPERATURE = 0.01
TOP_P = 0.9
DEFAULT_TEMPERATURES = "0.2,0.4,0.6"
DISTILL_TEMPERATURE = 4.0
DISTILL_ALPHA = 0.7
MICRO_BATCH = 2
GRAD_ACCUMULATION = 4
NUM_EPOCHS = 3
MAX_STEPS = 400
LOGGING_STEPS = 5
EVAL_STEPS = 25
SAVE_STEPS = 25
MAX_LENGTH = 2048
TOKEN_FALLBACK_FACTOR = 1.3

# Precision policy: first matching rule wins.
POLICY_HIGH_ALWAYS = ["k_proj", "v_proj"]      # 6 bit everywhere
POLICY_HIGH_EDGE = "down_proj"                 # 6 bit in the first / last layers
POLICY_HIGH_LAST = "o_proj"                    # 6 bit in the last layers
POLICY_FIRST_N = 3
POLICY_LAST_N = 3
POLICY_GROUP_SIZE = 64
POLICY_HIGH_BITS = 6
POLICY_BASE_BITS = 5
QUANT_BITS = [3, 5, 6, 8]

# NF4 codebook (QLoRA paper), ascending.
NF4_CODES = [
    -1.0, -0.6961928009986877, -0.5250730514526367, -0.39491748809814453,
    -0.28444138169288635, -0.18477343022823334, -0.09105003625154495, 0.0,
    0.07958029955625534, 0.16093020141124725, 0.24611230194568634, 0.33791524171829224,
    0.44070982933044434, 0.5626170039176941, 0.7229568362236023, 1.0,
]
# ---------------------------------------------------------------------------

NF4_MIDPOINTS = [(a + b) / 2.0 for a, b in zip(NF4_CODES[:-1], NF4_CODES[1:])]


def rule_set_tests(rule_set: str):
    """Ordered (test_ord, suite, test, clauses) for one rule set.

    clauses: list of lists of (needle, ignore_case, prefix_chars).
    """
    for name, prefix, eighth, _strip, reasoning_names in RULE_SETS:
        if name != rule_set:
            continue
        out = []
        for test, clauses in CODING_CHECKS + [eighth]:
            out.append(("coding", test, [[(n, ci, None) for n, ci in c] for c in clauses]))
        for test, clauses in zip(reasoning_names, REASONING_CLAUSES):
            out.append(("reasoning", test,
                        [[(n, ci, prefix if windowed else None) for n, ci, windowed in c]
                         for c in clauses]))
        return [(i, s, t, c) for i, (s, t, c) in enumerate(out)]
    raise ValueError(f"unknown rule set {rule_set!r}")


N_TESTS = 14


def rule_rows():
    """Long rule catalog rows (one per needle)."""
    rows = []
    for name, _prefix, _eighth, strip, _names in RULE_SETS:
        for test_ord, suite, test, clauses in rule_set_tests(name):
            for clause_id, clause in enumerate(clauses):
                for needle, ci, prefix in clause:
                    rows.append((name, strip, test_ord, suite, test, clause_id, needle, ci, prefix))
    return rows


RULE_SCHEMA = ("rule_set STRING, strip_think BOOLEAN, test_ord INT, suite STRING, test STRING, "
               "clause_id INT, needle STRING, ignore_case BOOLEAN, prefix_chars INT")


def rules_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), RULE_SCHEMA)


def tests_df(spark: SparkSession) -> DataFrame:
    """One row per (rule_set, test) with its CNF as a nested array column.

    clauses: ARRAY<ARRAY<STRUCT<needle, ignore_case, prefix_chars>>>; evaluated with
    higher-order functions so grading needs no aggregation or shuffle.
    """
    rows = []
    for name, _prefix, _eighth, strip, _names in RULE_SETS:
        for test_ord, suite, test, clauses in rule_set_tests(name):
            rows.append((name, strip, test_ord, suite, test,
                         [[{"needle": n, "ignore_case": ci, "prefix_chars": p} for n, ci, p in c]
                          for c in clauses]))
    schema = ("rule_set STRING, strip_think BOOLEAN, test_ord INT, suite STRING, test STRING, "
              "clauses ARRAY<ARRAY<STRUCT<needle: STRING, ignore_case: BOOLEAN, prefix_chars: INT>>>")
    return spark.createDataFrame(rows, schema)


def filler_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(FILLER_SENTENCES)), "choice INT, sentence STRING")


def double_array(values) -> F.Column:
    return F.array(*[F.lit(float(v)) for v in values])


def sql_double_list(values) -> str:
    """DuckDB literal for a DOUBLE[] with exact float reprs."""
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def sql_values_rules() -> str:
    """DuckDB VALUES body for the long rule catalog (used by the oracles)."""
    def q(s):
        return "'" + s.replace("'", "''") + "'"
    parts = []
    for rs, strip, ordv, suite, test, cid, needle, ci, prefix in rule_rows():
        parts.append(f"({q(rs)}, {str(strip).upper()}, {ordv}, {q(suite)}, {q(test)}, {cid}, "
                     f"{q(needle)}, {str(ci).upper()}, {('NULL' if prefix is None else prefix)})")
    return ",\n".join(parts)


RULE_COLUMNS = ("rule_set, strip_think, test_ord, suite, test, clause_id, needle, "
                "ignore_case, prefix_chars")
