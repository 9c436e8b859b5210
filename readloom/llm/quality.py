"""Text statistics per document, and a mixture model over them that tells prose from lists, tables and junk.

The statistics of a document and of its blocks (runs of lines that are not blank) are counted over the whole text in one
pass: the code points of many texts are one array, a table gives the class of each, and words, lines and blocks are
stretches of it. The standardised statistics of all blocks are fitted with a Gaussian mixture of full covariances by
expectation-maximization: every iteration sums the sufficient statistics of all blocks (some two thousand numbers per
input split, added up by a distributed aggregation), so nothing is sampled. A component means what the inspected examples
say that fall into it. A document is the sum of its blocks: its share of prose is the share of its characters in blocks
of components named prose, and its kind the one with most characters.
"""

from __future__ import annotations

import math
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.examples import EXAMPLES
from readloom.plans.runtime import materialize, spread

# Frequent function words of several languages.
COMMON = frozenset("""
a about after all also although always am an and any are around as at away back be because been before behind being below between both but by can cannot could did do does done down
during each either else enough even every few first for from further get give given good had has have having he her here hers him his how i if in instead into is it its itself just keep
last least left less let like long look made make many may me might more most much must my near need never no nobody none nor not note nothing now of off often on once one only or other others our out over
own part per put rather same see seen several she should since so some someone something soon still such take than that the their them then there these they thing this those though through till to too
under until up upon us use used very want was way we week well went were what when where whether which while who whom whose why will with within without would yet you your
aber alle als also am an andere auch auf aus bei bis bleibt da damit danach dann das dass dem den der des die dies diese dieser doch durch ein eine einem einen einer er es folgt für gegen hat hier ich ihr ihre im in ist
ja kann kein keine man mehr mit nach nicht noch nun nur ob oder ohne sehr sein sich sie sieht sind so steht über um und uns unter viel vom von vor war warum was weg weil wenn wer werden wie wir wird wo zu zuerst zum zur zusammen
à afin ainsi alors après au aussi autre aux avec bien car ce ceci cela celle ces cet cette chaque ci comme comment dans de depuis des donc du elle elles en encore entre est et être eux fait fois il ils ici je
jusqu la là le les leur lorsque lui mais me même moins mon ne ni non nos notre nous on ont ou où par parce pas peu plus plusieurs pour pourquoi puis qu quand que quel quelle qui quoi reste sa sans se ses si son sont sous sur ta te toujours tous tout très tu un une vers voici voit vous y
al algo ahora ante antes aquí así aún aunque bajo bien cada casi como con contra cual cuando de del desde después donde dos el ella ellos en entonces entre era es esa ese eso esta está este esto fue ha hace hacia hasta hay la las le lo los más me mi mientras muy nada ni no nos nosotros o
otra otro para pero poco por porque primero puede pues que qué quien se sea según ser si sí siempre sigue sin sino sobre son su sus también tan tanto te tiene todo todos tras tu un una uno vamos vez ve y ya yo
а без более больше бы был была были было быть в вам вас ведь во вот все всё всех вы где да даже для до его ее её если есть ещё еще же за здесь и из или им их к как какой когда конце которая которые который кто ли лишь меня мне может мы на над надо нам нас не него нее нет ни них но ну о об однако он она они оно от очень по под после потом потому почему при про раз с сам
самый сначала со снова так также такая такой там то тогда того тоже той только том тот ту ты у уж уже хотя чего чем через что чтобы эта эти это этого этой этом этот я
di il lo gli che non per una sono nel della con più anche come questo quando dove perché
o os as um uma não com para mais mas foi quando também pelo pela isso seu sua entre depois
het een van dat niet met voor zijn maar ook naar dan deze wordt
""".split())
#: Frequent characters of Chinese and Japanese running text.
COMMON_HAN = frozenset("的一是不了在有我他这中来上个们到说为子和你地出也得里后以会着下过能对就还没都而之与其如果那么么把被让很再请先所但因此从看只可吗呢吧并或于将の")

LETTER, DIGIT, SPACE, LINE, HAN, COMMON_ONE, STOP, HAN_STOP, LAST, CLOSE, MARK, POINT, PUNCT = (1 << i for i in range(13))
#: Characters of each class that is not told by the Unicode category. Fixed values.
_MEMBERS = {
    LINE: "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029",
    COMMON_ONE: "".join(sorted(COMMON_HAN)),
    STOP: ".!?\u2026",
    HAN_STOP: "\u3002\uff01\uff1f",
    LAST: ".!?\u2026\u3002\uff01\uff1f:;\uff1b\"'\u201d)",
    CLOSE: "\"'\u201d\u2019\u00bb)]*_`",
    MARK: "-*+\u2022\u2023\u25e6\u00b7",
    POINT: ".)",
    PUNCT: ".,;:!?'\"\u2018\u2019\u201c\u201d\u2026-()\u2013\u2014\u00ab\u00bb\u3001\u3002\uff0c\uff1a\uff1b\uff01\uff1f",
}
#: First and last character of the blocks of Chinese and Japanese writing, where every character is a word.
HAN_RANGES = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF))
#: Texts are measured in pieces of about this many characters, cut between blocks where there is a blank line.
PIECE = 1 << 20


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The classes of every code point, and its small letter."""
    t, low = np.zeros(0x110000, np.uint16), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        k = unicodedata.category(ch)[0]
        if k in "LM":
            t[c] = LETTER
            if len(s := ch.lower()) == 1:
                low[c] = ord(s)
        elif k == "N":
            t[c] = DIGIT
        if ch.isspace():
            t[c] |= SPACE
    for bit, chars in _MEMBERS.items():
        for ch in chars:
            t[ord(ch)] |= bit
    for a, b in HAN_RANGES:
        t[a : b + 1] |= HAN | LETTER
    return t, low


_POW = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(32)], np.uint64)


def _hash(code: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A number of 64 bits for each of the words that ``code`` holds one after the other."""
    if not len(lens):
        return np.zeros(0, np.uint64)
    at = np.cumsum(lens) - lens
    pos = np.minimum(np.arange(len(code)) - np.repeat(at, lens), len(_POW) - 1)
    return np.add.reduceat(code.astype(np.uint64) * _POW[pos], at) ^ (lens.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


@cache
def _common() -> np.ndarray:
    ws = sorted(COMMON)
    return np.sort(_hash(np.frombuffer("".join(ws).encode("utf-32-le"), np.uint32), np.array([len(w) for w in ws])))


def _sum(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


def _after(a: np.ndarray, by: int = 1) -> np.ndarray:
    """The value ``by`` places on, false beyond the end."""
    return np.concatenate([a[by:], np.zeros(min(by, len(a)), a.dtype)])


def _before(a: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(min(1, len(a)), a.dtype), a[:-1]])


#: What is counted in every block.
COUNTS = ("solid", "words", "letters", "common", "digits", "symbols", "odd", "stops", "lines", "punct_lines", "item_lines")


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each block, in order, the number of its text and its COUNTS.

    A word is a run of letters and marks, or one Chinese or Japanese character. A line ends in punctuation if there is
    some behind its last letter or digit. ``odd`` symbols are those no sentence has, behind the start of a line;
    ``stops`` are ends of sentences.
    """
    table, low = _classes()
    code = np.frombuffer("".join(t + "\n\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return np.zeros(0, np.int64), np.zeros((0, len(COUNTS)), np.int64)
    cls = table[code]
    is_ = lambda bit: (cls & bit) != 0
    space, han, digit = is_(SPACE), is_(HAN), is_(DIGIT)
    run = is_(LETTER) & ~han
    known = run | han | digit
    starts, ends = np.flatnonzero(run & ~_before(run)), np.flatnonzero(run & ~_after(run)) + 1
    common = is_(COMMON_ONE)
    if len(starts):
        h, want = _hash(low[code[run]], ends - starts), _common()
        common[starts[want[np.minimum(np.searchsorted(want, h), len(want) - 1)] == h]] = True
    word = han.copy()
    word[starts] = True
    symbol = ~known & ~space
    stop = is_(STOP) & (_after(space) | _after(is_(CLOSE))) & ~_before(digit) | is_(HAN_STOP)
    sep = np.flatnonzero(is_(LINE) & ~((code == 13) & (_after(code) == 10)))
    at = np.concatenate([[0], sep[:-1] + 1])
    solid = _sum(~space)
    full = solid[sep] > solid[at]
    here = np.arange(len(code))
    tail = np.maximum(np.maximum.accumulate(np.where(known, here, -1))[np.maximum(sep - 1, 0)] + 1, at)
    body = np.minimum(np.minimum.accumulate(np.where(known, here, len(code))[::-1])[::-1][at], sep)
    last, mark, odd, stops = _sum(is_(LAST)), _sum(is_(MARK)), _sum(symbol & ~is_(PUNCT)), _sum(stop)
    end_of_number = is_(POINT) & (_after(space) | _after(digit))
    number = digit & (_after(end_of_number) | _after(digit & (_after(end_of_number) | _after(digit & _after(end_of_number)))))  # of up to three digits
    first = np.minimum(body, len(code) - 1)
    item = (body < sep) & (mark[body] > mark[at]) | number[first]
    per = [(c := _sum(x))[sep] - c[at] for x in (word, run | han, common, digit, symbol)]
    cols = [solid[sep] - solid[at], *per, odd[sep] - odd[body], stops[sep] - stops[body], full, last[sep] > last[tail], item]
    size = np.cumsum([len(t) + 2 for t in texts])
    begins = full & ~_before(full)
    k = np.flatnonzero(full)
    block = np.cumsum(begins)[k] - 1
    n = int(begins.sum())
    out = np.stack([np.bincount(block, c[k].astype(np.float64), n) for c in cols], 1).astype(np.int64)
    return np.searchsorted(size, at[begins], "right"), out


def _pieces(text: str) -> list[str]:
    """A very long text in pieces, cut at blank lines, or at line ends where there is none within a piece."""
    out, i = [], 0
    while len(text) - i > PIECE:
        end = i + PIECE
        if (at := text.rfind("\n\n", i, end)) >= 0:
            cut = at + 2
        elif (at := text.rfind("\n", i, end)) >= 0:
            cut = at + 1
        else:
            cut = text.find("\n", end) + 1 or len(text)
        out.append(text[i:cut])
        i = cut
    return [*out, text[i:]]


def counts(texts: list[str | None]) -> list[np.ndarray]:
    """COUNTS of the blocks of every text; none for texts that are null, empty or blank."""
    jobs = [(i, p) for i, t in enumerate(texts) if t for p in _pieces(t)]
    got: list[list[np.ndarray]] = [[] for _ in texts]
    i = 0
    while i < len(jobs):
        j, size = i, 0
        while j < len(jobs) and (j == i or size + len(jobs[j][1]) <= PIECE):
            size += len(jobs[j][1])
            j += 1
        of, c = measure([p for _, p in jobs[i:j]])
        cut = np.searchsorted(of, np.arange(j - i + 1))
        for n in range(j - i):
            got[jobs[i + n][0]].append(c[cut[n] : cut[n + 1]])
        i = j
    none = np.zeros((0, len(COUNTS)), np.int64)
    return [np.concatenate(g) if g else none for g in got]


#: The statistics of a document, in this order.
STATS = ("n_words", "mean_word_len", "symbol_share", "punct_line_share", "common_share")
#: The counts they come from.
TOTALS = {"solid": "n_solid", "words": "n_words", "letters": "n_letters", "common": "n_common", "symbols": "n_symbols", "lines": "n_lines", "punct_lines": "n_punct_lines"}


def statistics(c: np.ndarray) -> tuple[float, ...] | None:
    """The statistics of a document from the COUNTS of its blocks, or None if it has none.

    Shares of characters are of those not blank, shares of lines of the lines not blank.
    """
    if not len(c):
        return None
    t = dict(zip(COUNTS, c.sum(0).tolist()))
    w = max(t["words"], 1)
    return float(t["words"]), t["letters"] / w, t["symbols"] / t["solid"], t["punct_lines"] / t["lines"], t["common"] / w


def features(c: np.ndarray) -> np.ndarray:
    """What the mixture sees of blocks (rows x COUNTS): words, their mean length, shares of odd symbols, digits, lines
    ending in punctuation and common words, words of a sentence and of a line, share of list items."""
    t = dict(zip(COUNTS, c.T.astype(np.float64)))
    w, lines = t["words"], np.maximum(t["lines"], 1)
    per = np.maximum(w, 1)
    return np.stack(
        [
            np.log1p(w), np.log1p(t["letters"] / per), np.sqrt(t["odd"] / t["solid"]), np.sqrt(t["digits"] / t["solid"]), t["punct_lines"] / lines, t["common"] / per,
            np.log1p(w / (t["stops"] + 0.5)), np.log1p(w / lines), t["item_lines"] / lines,
        ], 1,
    )


def text_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``blocks``, the COUNTS of its blocks one after the other, of every row; texts are read whole."""
    cols = spread(df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t")))

    def run(batches):
        for b in batches:
            c = counts(b.column(1).to_pylist())
            off = np.concatenate([[0], np.cumsum([x.size for x in c])]).astype(np.int32)
            flat = np.concatenate([x.ravel() for x in c]).astype(np.int32) if c else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(off, flat)], names=[id_col, "blocks"])

    return cols.mapInArrow(run, f"`{id_col}` {cols.schema['i'].dataType.simpleString()}, blocks array<int>")


def _blocks(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all blocks of a column, and the number of blocks of every row."""
    return col.flatten().to_numpy().reshape(-1, len(COUNTS)), np.diff(col.offsets.to_numpy()) // len(COUNTS)


def text_totals(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and the counts behind the statistics of every row; 0 for texts that are null, empty or blank."""
    blocks = text_counts(df, id_col, text)
    at = [COUNTS.index(c) for c in TOTALS]

    def run(batches):
        for b in batches:
            c, n = _blocks(b.column(1))
            total = np.concatenate([np.zeros((1, len(COUNTS)), np.int64), np.cumsum(c, 0, dtype=np.int64)])
            end = np.cumsum(n)
            t = total[end] - total[end - n]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(t[:, i]) for i in at)], names=[id_col, *TOTALS.values()])

    return blocks.mapInArrow(run, f"`{id_col}` {blocks.schema[0].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in TOTALS.values()))


#: Added to the variances of a component, in units of the standardised statistics.
FLOOR = 0.05
#: Variance of a component at the start.
START = 0.3
MAX_ITERATIONS = 25
#: Blocks evaluated at once.
ROWS = 1 << 15


class Mixture:
    """Gaussian mixture with full covariances over standardised features; ``label`` names the components."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, mu: np.ndarray):
        self.mean, self.std, self.mu = mean, std, mu
        k, d = mu.shape
        self.weight, self.cov = np.full(k, 1 / k), np.repeat(np.eye(d)[None] * START, k, 0)
        self.upper = np.triu_indices(d)
        self.label: list[str] = []
        self.ready()

    def ready(self) -> None:
        """The log densities as linear functions of the products of the features: one matrix product gives them all."""
        inv = np.linalg.inv(self.cov)
        i, j = self.upper
        quad = -np.where(i == j, 0.5, 1.0) * inv[:, i, j]
        line = np.einsum("kij,kj->ki", inv, self.mu)
        const = np.log(self.weight) - 0.5 * (np.linalg.slogdet(self.cov)[1] + self.mu.shape[1] * math.log(2 * math.pi) + (line * self.mu).sum(1))
        self.coef = np.concatenate([quad, line, const[:, None]], 1).T

    def terms(self, c: np.ndarray) -> np.ndarray:
        z = (features(c) - self.mean) / self.std
        i, j = self.upper
        return np.concatenate([z[:, i] * z[:, j], z, np.ones((len(z), 1))], 1)

    def responsibilities(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of each component for each block, the terms they were computed from, and the log likelihood."""
        t = self.terms(c)
        p = t @ self.coef
        top = p.max(1, keepdims=True)
        np.exp(p - top, out=p)
        total = p.sum(1, keepdims=True)
        p /= total
        return p, t, float((np.log(total) + top).sum())

    def sums(self, c: np.ndarray) -> np.ndarray:
        """Log likelihood and sufficient statistics of blocks."""
        out = np.zeros(1 + self.coef.size)
        for i in range(0, len(c), ROWS):
            r, t, ll = self.responsibilities(c[i : i + ROWS])
            out[0] += ll
            out[1:] += (r.T @ t).ravel()
        return out

    def update(self, s: np.ndarray) -> None:
        k, d = self.mu.shape
        s = s.reshape(k, -1)
        w = s[:, -1]
        i, j = self.upper
        for n in np.flatnonzero(w > 2 * d):  # others keep what they have
            self.mu[n] = s[n, -1 - d : -1] / w[n]
            cov = np.empty((d, d))
            cov[i, j] = cov[j, i] = s[n, : len(i)] / w[n] - self.mu[n][i] * self.mu[n][j]
            self.cov[n] = cov + np.eye(d) * FLOOR
        self.weight = np.maximum(w / w.sum(), 1e-9)
        self.weight /= self.weight.sum()
        self.ready()

    def kinds(self, c: np.ndarray) -> np.ndarray:
        """Probability of every kind of KINDS for every block."""
        of = np.array([[x == k for k in KINDS] for x in self.label], float)
        return np.concatenate([np.zeros((0, len(KINDS))), *(self.responsibilities(c[i : i + ROWS])[0] @ of for i in range(0, len(c), ROWS))])


KINDS = ("prose", "list", "table", "junk")


def _sums(df: DataFrame, width: int, fn) -> np.ndarray:
    """Sum over all blocks of what ``fn`` makes of their counts; one short array per split reaches a reducer."""

    def run(batches):
        acc = np.zeros(width)
        for b in batches:
            if len(c := _blocks(b.column(0))[0]):
                acc += fn(c)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(acc)], names=["k", "v"])

    out = np.zeros(width)
    for r in df.select("blocks").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


def _moments(c: np.ndarray) -> np.ndarray:
    x = features(c)
    return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])


def fit(blocks: DataFrame, iterations: int = MAX_ITERATIONS) -> Mixture:
    """Fit to the blocks of all rows. Components start at the inspected examples, so a fit is repeatable. No rows leave
    the mixture at the examples."""
    ex = [(kind, c) for kind, text in EXAMPLES for c in counts([text])[0]]
    what, c = np.array([k for k, _ in ex]), np.array([c for _, c in ex])
    x = features(c)
    d = x.shape[1]
    total = _sums(blocks, 2 * d + 1, _moments)
    n = total[0]
    total = total if n else _moments(c)
    mean = total[1 : d + 1] / total[0]
    std = np.sqrt(np.maximum(total[d + 1 :] / total[0] - mean**2, 0) + 1e-6)
    m = Mixture(mean, std, (x - mean) / std)
    last = None
    for _ in range(iterations if n else 0):
        s = _sums(blocks, 1 + m.coef.size, m.sums)
        m.update(s[1:])
        if last is not None and abs(s[0] - last) < 1e-3 * n:
            break
        last = s[0]
    r, z = m.responsibilities(c)[0], (x - mean) / std
    m.label = [_name(r[:, i], what, ((z - m.mu[i]) ** 2).sum(1)) for i in range(len(ex))]
    return m


def _name(share: np.ndarray, what: np.ndarray, far: np.ndarray) -> str:
    """The kind of the examples that fall into a component; where none does, that of the nearest."""
    votes = {k: share[what == k].sum() for k in KINDS}
    best = max(votes, key=votes.get)
    return best if votes[best] > 0.05 else str(what[far.argmin()])


def classify(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, the statistics, ``kind`` (prose, list, table, junk) and ``prose_share`` of every row.

    A text is prose if at least half of its characters are. Texts that are null, empty or blank have neither statistics
    nor kind. Repeated texts get the same kind. An empty table gives no rows. Other columns are not read.
    """
    blocks = materialize(text_counts(df, id_col, text))
    m = fit(blocks)

    def run(batches):
        for b in batches:
            c, n = _blocks(b.column(1))
            end = np.cumsum(n)
            by = np.concatenate([np.zeros((1, len(KINDS))), np.cumsum(m.kinds(c) * c[:, :1], 0)])
            by = by[end] - by[end - n]
            solid, ok = by.sum(1), n > 0
            share = by[:, 0] / np.where(ok, solid, 1)
            kind = np.where(share >= 0.5, 0, 1 + by[:, 1:].argmax(1))
            st = [statistics(c[e - k : e]) or (None,) * len(STATS) for e, k in zip(end, n)]
            cols = [pa.array(v, pa.float64()) for v in (zip(*st) if st else [()] * len(STATS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(np.array(KINDS)[kind].tolist(), pa.string(), mask=~ok), pa.array(share, mask=~ok)], names=[id_col, *STATS, "kind", "prose_share"])

    return blocks.mapInArrow(run, f"`{id_col}` {blocks.schema[0].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in STATS) + ", kind string, prose_share double")
