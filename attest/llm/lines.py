"""Quality rules by labelling the lines of a text as content or boilerplate.

A linear-chain conditional random field scores each line by its features and each step between lines; Viterbi decoding
finds the best labelling, and the share of words in content lines decides whether a document stays. The field is fitted
by gradient ascent on a bounded sample of labelled documents. All counts cover whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import arrow_map
from attest.llm.hashing import piece_hashes, shingles_of, slices, text_column, words_of

WINDOW = 5
SAMPLE_DOCS = 3_000  # labelled documents of which the field is fitted, at most about this many
CHAIN = 16  # lines of a training chain; longer documents give several
FEATURES = ["one", "words", "short", "symbols", "signs", "upper", "same", "repeated", "duplicate", "digits", "single"]
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
_SIGNS = np.zeros(256, np.int64)
_SIGNS[[ord(c) for c in "!?~^=_{}[]\\/"]] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[97:123] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _seen_before(doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Items whose (doc, code) occurs at an earlier place."""
    order = np.lexsort((np.arange(len(doc)), code, doc))
    again = np.zeros(len(doc), bool)
    again[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (code[order[1:]] == code[order[:-1]])
    return again


@dataclass
class Lines:
    """Counts of every text of a batch, and the lines that have a word: text number, words, features."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    doc: np.ndarray
    words: np.ndarray
    features: np.ndarray


def lines_of(column: pa.Array) -> Lines:
    raw, at = text_column(column)
    docs = len(at) - 1
    words = words_of(raw, at)
    n_words = words.counts(docs)
    heads = _sums((raw & 0xC0) != 0x80)
    word_chars = np.bincount(words.doc, weights=heads[words.end] - heads[words.start], minlength=docs).astype(np.int64)
    symbols = _sums(_SYMBOLS[raw])
    # words in windows that occur twice or more in their text
    first = np.flatnonzero(words.doc[:len(words.doc) - WINDOW + 1] == words.doc[WINDOW - 1:]) if len(words.doc) >= WINDOW else \
        np.zeros(0, np.int64)
    window_doc, window = shingles_of(words, WINDOW)
    twice = np.zeros(len(words.doc) + 1, np.int64)
    if len(first):
        order = np.lexsort((window, window_doc))
        d, w = window_doc[order], window[order]
        equal = (d[1:] == d[:-1]) & (w[1:] == w[:-1])
        met = first[order[np.r_[equal, False] | np.r_[False, equal]]]
        np.add.at(twice, met, 1)
        np.add.at(twice, met + WINDOW, -1)
    repeated = np.cumsum(twice)[:-1] > 0
    n_repeat = np.bincount(words.doc[repeated], minlength=docs)
    # lines: runs of words between line feeds of one text
    feeds = np.flatnonzero(raw == 10)
    cuts = np.unique(np.concatenate([at[:-1], feeds + 1]))  # a line starts here; empty texts add nothing
    cuts = cuts[cuts < len(raw)]
    line_of_word = np.searchsorted(cuts, words.start, side="right") - 1
    lines, begin_word, many = np.unique(line_of_word, return_index=True, return_counts=True)
    starts = cuts[lines] if len(lines) else np.zeros(0, np.int64)
    doc = words.doc[begin_word] if len(lines) else np.zeros(0, np.int64)
    next_feed = np.searchsorted(feeds, starts)
    ends = np.minimum(np.r_[feeds, len(raw)][next_feed], at[doc + 1]) if len(lines) else starts
    duplicate = _seen_before(doc, piece_hashes(raw, starts, ends))
    n_dup = np.bincount(doc[duplicate], minlength=docs)
    follows = np.zeros(len(words.doc), bool)
    follows[1:] = (words.code[1:] == words.code[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    last_word = begin_word + many
    per_word = lambda flags: (lambda s: (s[last_word] - s[begin_word]) / np.maximum(many, 1))(_sums(flags))
    in_line = lambda table: (lambda s: s[ends] - s[starts])(_sums(table[raw]))
    upper, lower, size = in_line(_UPPER), in_line(_LOWER), np.maximum(ends - starts, 1)
    features = np.stack([
        np.ones(len(lines)), np.log1p(many) / 4, (many < 5).astype(float), np.minimum(in_line(_SYMBOLS) / np.maximum(many, 1), 2),
        np.minimum(in_line(_SIGNS) / np.maximum(many, 1), 2), upper / np.maximum(upper + lower, 1), per_word(follows),
        per_word(repeated), duplicate.astype(float), in_line(_DIGIT) / size, per_word(words.end - words.start == 1)], 1)
    return Lines(n_words, word_chars, symbols[at[1:]] - symbols[at[:-1]], n_dup, n_repeat, doc, many, features)


@dataclass
class Field:
    """Weights of a two-label chain: 0 boilerplate, 1 content. emission scores label 1, step[i, j] goes from i to j."""

    emission: np.ndarray
    step: np.ndarray


# For use without labels: lines of plain prose are content, symbols, shouting and repetition are not.
DEFAULT = Field(np.array([2.5, 0.0, 0.0, -5.0, -5.0, -5.0, -6.0, -3.0, -0.5, -4.0, -5.0]), np.array([[0.5, -0.5], [-0.5, 0.5]]))


def viterbi(scores: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best labels of chains that lie in a row; `scores` of label 1 against label 0, `sizes` of the chains."""
    heads = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    sizes, heads = sizes[order], heads[order]
    from_one = np.zeros((len(scores), 2), bool)  # the label before, for either label
    zero, one = np.zeros(len(sizes)), np.zeros(len(sizes))
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # chains with more than t lines
    for t in range(longest):
        n = active[t]
        place = heads[:n] + t
        if t == 0:
            one[:n] = scores[place]
            continue
        a0, a1 = zero[:n] + step[0, 0], one[:n] + step[1, 0]
        b0, b1 = zero[:n] + step[0, 1], one[:n] + step[1, 1]
        from_one[place, 0], from_one[place, 1] = a1 > a0, b1 > b0
        zero[:n], one[:n] = np.maximum(a0, a1), np.maximum(b0, b1) + scores[place]
    label = one > zero
    out = np.zeros(len(scores), bool)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        place = heads[:n] + t
        out[place] = label[:n]
        label[:n] = from_one[place, label[:n].astype(np.int64)]
    return out


def fit(chains: list[tuple[np.ndarray, int]], rounds: int = 250, decay: float = 0.001) -> Field:
    """Gradient ascent on the likelihood of chains (features of lines, label of all of them)."""
    parts = [(f[k:k + CHAIN], y) for f, y in chains for k in range(0, len(f), CHAIN)]
    if len({y for _, y in parts}) < 2:
        return DEFAULT
    longest, n = max(len(f) for f, _ in parts), len(parts)
    x = np.zeros((n, longest, len(FEATURES)))
    mask = np.zeros((n, longest), bool)
    y = np.array([v for _, v in parts])
    for k, (f, _) in enumerate(parts):
        x[k, :len(f)], mask[k, :len(f)] = f, True
    emission, step = np.zeros(len(FEATURES)), np.zeros((2, 2))
    pairs = mask[:, 1:]
    truth = np.zeros((2, 2))
    for v in (0, 1):
        truth[v, v] = pairs[y == v].sum()
    seen = (np.where(y[:, None] == 1, mask, False)[..., None] * x).sum((0, 1))
    m_e, v_e, m_s, v_s = 0.0, 0.0, 0.0, 0.0
    total = mask.sum()
    for turn in range(1, rounds + 1):
        score = np.zeros((n, longest, 2))
        score[..., 1] = x @ emission
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            held = np.logaddexp(ahead[:, t - 1, 0, None] + step[0], ahead[:, t - 1, 1, None] + step[1]) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], held, ahead[:, t - 1])
        behind = np.zeros((n, longest, 2))
        for t in range(longest - 2, -1, -1):
            after = behind[:, t + 1] + score[:, t + 1]
            held = np.logaddexp(step[:, 0] + after[:, 0, None], step[:, 1] + after[:, 1, None])
            behind[:, t] = np.where(mask[:, t + 1, None], held, 0.0)
        whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        one = np.exp(ahead[..., 1] + behind[..., 1] - whole[:, None]) * mask
        joint = np.exp(ahead[:, :-1, :, None] + step + (score + behind)[:, 1:, None, :] - whole[:, None, None, None])
        expected = (joint * pairs[..., None, None]).sum((0, 1))
        g_e = (seen - (one[..., None] * x).sum((0, 1))) / total - decay * emission / 10
        g_s = (truth - expected) / total - decay * step
        m_e, v_e = 0.9 * m_e + 0.1 * g_e, 0.99 * v_e + 0.01 * g_e ** 2
        m_s, v_s = 0.9 * m_s + 0.1 * g_s, 0.99 * v_s + 0.01 * g_s ** 2
        rate = 0.15 / (1 - 0.9 ** turn)
        emission = emission + rate * m_e / (np.sqrt(v_e / (1 - 0.99 ** turn)) + 1e-8)
        step = step + rate * m_s / (np.sqrt(v_s / (1 - 0.99 ** turn)) + 1e-8)
    return Field(emission, step)


def _feature_rows(batch: pa.RecordBatch):
    for part in slices(batch, "text"):
        found = lines_of(part.column("text"))
        stops = np.cumsum(np.bincount(found.doc, minlength=part.num_rows))
        rows = [f.ravel() for f in np.split(found.features, stops[:-1])]
        yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(rows, pa.list_(pa.float64()))], names=["label", "lines"])


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          most: int = SAMPLE_DOCS) -> Field:
    """A field from about `most` labelled documents at most, drawn by a hash of their ids; the lines of a document take
    its label. Of several labels of one id the smallest counts; without both labels the default weights are used."""
    marks = labels.where(F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{label}`").isin(0, 1)).groupBy(
        F.col(f"`{doc_id}`").alias("id")).agg(F.min(f"`{label}`").cast("int").alias("label"))
    share = F.lit(min(1.0, most / max(1, marks.count())))
    drawn = marks.where(F.xxhash64("id", F.lit("lines")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)) < share)
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(
        F.broadcast(drawn), "id").select("text", "label")  # drawn: `most` rows, give or take the spread of the draw
    rows = arrow_map(texts, _feature_rows, "label int, lines array<double>").collect()
    chains = sorted(((r.label, r.lines) for r in rows if r.lines))
    return fit([(np.array(f).reshape(-1, len(FEATURES)), y) for y, f in chains])


def _judge(columns: list[str], text: str, field: Field, least_words: int, most_repeated: float, least_content: float):
    def rows(batch: pa.RecordBatch):
        for part in slices(batch, text):
            f = lines_of(part.column(text))
            sizes = np.bincount(f.doc, minlength=part.num_rows)
            content = viterbi(f.features @ field.emission, sizes[sizes > 0], field.step)
            words = np.bincount(f.doc, weights=f.words * content, minlength=part.num_rows)
            share = words / np.maximum(f.n_words, 1)
            failed = (f.n_words < least_words) | (f.n_repeat_words > most_repeated * f.n_words)
            kept = ~failed & (share >= least_content)
            numbers = [f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in columns), *(pa.array(x, pa.int64()) for x in numbers), pa.array(share),
                 pa.array(failed), pa.array(kept)], names=[*columns, *RESULT])

    return rows


RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept"]


def judge(docs: DataFrame, columns: list[str], field: Field = DEFAULT, text: str = "text", least_words: int = 10,
          most_repeated: float = 0.2, least_content: float = 0.5, prefix: str = "") -> DataFrame:
    """`columns` of every row with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_share, base_failed
    and kept, each named after `prefix`.

    A null or empty text has no words and fails the base rules; documents without lines have content share 0; repeated rows
    are judged alike; ties of the labelling go to boilerplate; an empty table gives no rows. Memory follows the longest text.
    """
    inner = [f"__{k}" for k in range(len(columns))]
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(columns, inner)], *([] if text in columns else [body.alias("__text")]))
    place = inner[columns.index(text)] if text in columns else "__text"
    shape = ", ".join(f"{i} {rows.schema[i].dataType.simpleString()}" for i in inner)
    counts = ", ".join(f"{c} long" for c in RESULT[:5])
    return arrow_map(rows, _judge(inner, place, field, least_words, most_repeated, least_content),
                     f"{shape}, {counts}, content_share double, base_failed boolean, kept boolean").toDF(
        *columns, *[prefix + c for c in RESULT])
