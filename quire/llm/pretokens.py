"""Vectorised pre-tokenisation without a regular expression.

The split pattern of the public byte-level vocabularies is a finite automaton over
code-point classes. Each character becomes a symbol (its class, refined by what
follows it); a symbol is a function from states to states. Those functions compose
associatively, so blocks of text are composed independently of each other, the
block functions are combined by a doubling scan, and a second pass replays every
block from its now known first state and reads off where tokens start.
"""

from __future__ import annotations

from functools import cache

import numpy as np

# The alternatives of the split pattern, in its order.
#   's 't 're 've 'm 'll 'd | ' '? letters | ' '? numbers | ' '? others | white space
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")

LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
#: Symbols: classes, white space inside a run or right before a non-blank, apostrophes that
#: may open a contraction of one or two letters.
(S_LETTER, S_NUMBER, S_OTHER, S_IN_RUN, S_LAST_SPACE, S_LAST_BLANK, S_ONE, S_TWO) = range(8)
N_SYMBOLS = 8
#: States: what the character just read belongs to.
(AT_START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, AFTER_BLANK,
 WANT_ONE, WANT_TWO, AFTER_CONTRACTION) = range(10)
N_STATES = 10
BLOCK = 128


@cache
def class_table() -> np.ndarray:
    """Class of each code point. The letters and numbers are asked of the tokenizer
    library, whose Unicode version differs from Python's; without it there is no answer that is right."""
    import tiktoken

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    table = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        table[[ord(c) for c in probe.decode(probe.encode_ordinary(every))]] = kind
    table[0x20] = SPACE
    return table


def _next_state(state: int, symbol: int) -> int:
    if symbol == S_LETTER:
        return {WANT_TWO: WANT_ONE, WANT_ONE: AFTER_CONTRACTION}.get(state, IN_LETTERS)
    if symbol in (S_ONE, S_TWO):
        if state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS
        return WANT_ONE if symbol == S_ONE else WANT_TWO
    return {S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS, S_IN_RUN: IN_BLANKS,
            S_LAST_SPACE: AFTER_SPACE, S_LAST_BLANK: AFTER_BLANK}[symbol]


def _starts(state: int, symbol: int) -> bool:
    """Does a token start at a character with this symbol, read in this state?"""
    if symbol in (S_LAST_SPACE, S_LAST_BLANK):
        return True
    joins = {S_LETTER: (IN_LETTERS, WANT_ONE, WANT_TWO, AFTER_SPACE), S_NUMBER: (IN_NUMBERS, AFTER_SPACE),
             S_IN_RUN: (IN_BLANKS,)}
    return state not in joins.get(symbol, (IN_OTHERS, AFTER_SPACE))


@cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Flat tables by symbol * states + state; symbols from N_SYMBOLS on open a text."""
    pairs = [(AT_START if first else state, symbol)
             for first in (False, True) for symbol in range(N_SYMBOLS) for state in range(N_STATES)]
    step = np.array([_next_state(*p) for p in pairs], np.uint8)
    start = np.array([first or _starts(*p) for p, first in
                      zip(pairs, [False] * (N_SYMBOLS * N_STATES) + [True] * (N_SYMBOLS * N_STATES), strict=True)], bool)
    return step, start


def _symbols(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbol of each character; ``first`` marks the first character of each text."""
    kind = classes[points]
    n = len(points)
    blank = kind >= SPACE
    ends = np.append(first[1:], True)  # the last character of a text
    more = np.append(~blank[1:], False) & ~ends  # a non-blank follows in the same text
    symbol = kind.copy()  # letters, numbers and others keep their number
    symbol[blank] = S_IN_RUN
    symbol[(kind == SPACE) & more] = S_LAST_SPACE
    symbol[(kind == BLANK) & more] = S_LAST_BLANK
    quotes = np.flatnonzero(points == ord("'"))
    if len(quotes):
        one = np.append(points, (0, 0))
        here = ~np.append(ends, (True, True))
        a, b = one[quotes + 1], one[quotes + 2]
        near = here[quotes]
        far = near & here[np.minimum(quotes + 1, n)]
        two = far & np.logical_or.reduce([(a == ord(p)) & (b == ord(q)) for p, q in TWO_LETTERS])
        single = near & np.isin(a, [ord(c) for c in ONE_LETTER])
        symbol[quotes[two]] = S_TWO
        symbol[quotes[single]] = S_ONE
    symbol[first] += N_SYMBOLS
    return symbol


def token_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Boolean per character: does a token start here?"""
    step, start = automaton()
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    blocks = -(-n // BLOCK)
    symbol = np.zeros(blocks * BLOCK, np.int32)
    symbol[:n] = _symbols(points, first, classes)
    columns = np.ascontiguousarray(symbol.reshape(blocks, BLOCK).T) * N_STATES
    # 1. the function of each block: where each state leads
    f = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (blocks, N_STATES))
    for column in columns:
        f = step.take(column[:, None] + f)
    # 2. inclusive doubling scan over the blocks; composition is associative
    reach, rows = 1, np.arange(blocks)[:, None]
    while reach < blocks:
        g = f.copy()
        g[reach:] = f[rows[reach:], f[:-reach]]
        f, reach = g, reach * 2
    # 3. replay each block from its first state
    state = np.empty(blocks, np.uint8)
    state[0] = AT_START
    state[1:] = f[:-1, AT_START]
    found = np.empty((BLOCK, blocks), bool)
    for j, column in enumerate(columns):
        at = column + state
        found[j] = start.take(at)
        state = step.take(at)
    return found.T.reshape(-1)[:n]


def slice_texts(texts: list[bytes], classes: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """All tokens of the texts as UTF-8 slices, in order, and the first token of each text
    (one more entry: the number of tokens). Joined, a text's slices are the text."""
    data = b"".join(texts)
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    widths = 1 + (points >= 0x80).view(np.int8) + (points >= 0x800).view(np.int8) + (points >= 0x10000).view(np.int8)
    at = np.zeros(len(points) + 1, np.int64)  # byte offset of each character
    np.cumsum(widths, out=at[1:])
    text_at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=text_at[1:])
    first = np.zeros(len(points), bool)
    opens = text_at[:-1][np.diff(text_at) > 0]
    first[np.searchsorted(at, opens)] = True
    starts = at[:-1][token_starts(points, first, classes)]
    cuts = np.append(starts, len(data)).tolist()
    tokens = [data[i:j] for i, j in zip(cuts, cuts[1:])]
    return tokens, np.searchsorted(starts, text_at)
