"""A hidden Markov language model: Baum-Welch counts from all tasks, exact likelihoods by scaled recursion.

Symbols are the end of a text, every word with more than 2**-16 of the training tokens (at most
2**16 of them), and 256 classes that share out all other words by their last two bytes. A word of a
class has the class's profile over the states times its own share of the class, (c + 1) / (sum of c + 1, and 1
for unseen words), so every word of the corpus has a probability of its own and the table of
counts grows with the corpus. Only the symbols' profiles, of bounded size, travel as a broadcast.

Texts are stored once as arrays of symbols. In each round every task runs the forward and backward
recursions over its texts and hands on expected counts of symbols, transitions and starts, which Spark
adds up; counts plus the pseudo-counts (one for each word and class of unseen words, dealt over the states) give the next
parameters. With one state the model is the base with one unseen word for each class.

Inside a task texts are cut into blocks of STEP tokens, and all blocks advance together, a token at a
time. A block's transfer matrix (the product of its steps) carries the state distribution from block to block,
forward and backward, so a block needs nothing from its neighbours but two vectors: a very long text is exact, and held in
groups of blocks.

The words of classes meet their counts in one join; a task sends each such word once for a slice of
texts, with its rows, and none of them is frequent.

Defined results: a null, empty or blank text is the end token alone. A null doc_id is learned from. Words
of more than LONGEST bytes have no symbol of their own. Repeated rows count and come back each. With nothing
to learn from, N and V are 0, every base term is log10(1) = 0, and the model is uniform. An empty table
gives an empty one. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ._bytes import flat, pieces
from ._shared import stored

#: Words above this share of the training tokens have their own symbol: at most as many as its inverse.
FREQUENT_WORDS, LONGEST, CLASSES = 1 << 16, 64, 256
STATES, ROUNDS, STICKY = 8, 5, 0.9
#: Tokens of a block, and tokens whose distributions are held together.
STEP, TOGETHER = 512, 1 << 18
SLICE, HELD = 1 << 22, 1 << 20
END = ""

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(texts) -> tuple[pa.StringArray, np.ndarray]:
    """All words, A-Z lower-cased, and the offsets of the texts in them."""
    body, ends = flat(texts)
    inside = np.zeros(len(body) + 2, bool)
    inside[1:-1] = ~_BLANK[body]
    cut = np.zeros(len(body) + 1, bool)
    cut[ends] = True
    begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    size = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1 - begin
    kept = _LOWER[body[inside[1:-1]]]  # words lie one after another
    offsets = np.append(0, np.cumsum(size))
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)), np.searchsorted(begin, ends)


def classes_of(words: pa.Array) -> np.ndarray:
    """The class of every word, from its last two bytes."""
    body, ends = flat(words)
    size = np.diff(ends)
    last = np.zeros((2, len(size)), np.int64)
    for i in (0, 1):
        some = size > i
        last[i, some] = body[ends[1:][some] - 1 - i]
    return (last[0] * 31 + last[1]) % CLASSES


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])


def word_counts(training: DataFrame, text: str) -> DataFrame:
    """word and n over all texts; the end token is the empty word."""

    def work(batches):
        held, texts = [], 0
        for part in pieces(batches, text, SLICE):
            texts += part.num_rows
            words, _ = words_of(part.column(0))
            found = words.value_counts()
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            if sum(t.num_rows for t in held) > HELD:
                held = [_summed(held)]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().cast(schema).to_batches()
        if texts:
            yield from _summed([*held, pa.table({"word": pa.array([END], pa.large_string()), "n": [texts]})]).cast(schema).to_batches()

    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    return training.select(text).mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Symbols:
    """The symbols: their words and counts, and what the classes of all other words hold."""

    words: list[str]  # from symbol 1; symbol 0 is the end token
    counts: np.ndarray  # of the end token and the words
    class_words: np.ndarray
    class_tokens: np.ndarray
    total: int
    distinct: int

    @property
    def size(self) -> int:
        return 1 + len(self.words) + CLASSES

    @property
    def slots(self) -> np.ndarray:
        """Pseudo-counts: one for each word, and one for a class's unseen words."""
        return np.concatenate([np.ones(1 + len(self.words)), self.class_words + 1.0])

    @property
    def seen(self) -> np.ndarray:
        return np.concatenate([self.counts, self.class_tokens])

    @property
    def shares(self) -> np.ndarray:
        """By what the profile of a class is divided for a word of c = 0."""
        return np.concatenate([np.ones(1 + len(self.words)), self.class_tokens + self.class_words + 1.0])


def symbols_of(counts: DataFrame) -> Symbols:
    """Frequent words collected, at most FREQUENT_WORDS of up to LONGEST bytes; the others only as sums of their classes."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often = (F.col("n") * FREQUENT_WORDS > total) & (F.octet_length("word") <= LONGEST) & (F.col("word") != END)
    own = sorted((r.word, r.n) for r in counts.filter(often).collect())
    end = counts.filter(F.col("word") == END).first()

    def by_class(batches):
        found = np.zeros((2, CLASSES), np.int64)
        for batch in batches:
            at = classes_of(batch.column(0))
            found[0] += np.bincount(at, minlength=CLASSES)
            np.add.at(found[1], at, batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), *(pa.array(x) for x in found)], names=["class", "words", "tokens"])

    rest = counts.filter(~often & (F.col("word") != END)).mapInArrow(by_class, "class long, words long, tokens long").groupBy("class").agg(F.sum("words"), F.sum("tokens"))
    words, tokens = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for i, w, n in rest.collect():  # CLASSES rows
        words[i], tokens[i] = w, n
    return Symbols([w for w, _ in own], np.array([end.n if end else 0, *(n for _, n in own)], np.int64), words, tokens, total, distinct)


def encoded(docs: DataFrame, symbols: Symbols, key: str, text: str, held: str) -> DataFrame:
    """Two kinds of rows: a text's symbols with what its frequent words add to the base, and a class's word with the rows that hold it."""
    known = docs.sparkSession.sparkContext.broadcast((symbols.words, np.log10(symbols.counts + 1.0), symbols.counts > 0))
    own = len(symbols.words) + 1
    kind = np.uint16 if symbols.size <= 1 << 16 else np.uint32
    schema = T.StructType([
        T.StructField("_row", T.LongType()), T.StructField("doc_id", docs.schema[key].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("_known", T.LongType()),
        T.StructField("_log", T.DoubleType()), T.StructField("_symbols", T.BinaryType()), T.StructField("_word", T.StringType()), T.StructField("_rows", T.ArrayType(T.LongType())), T.StructField("_times", T.ArrayType(T.LongType())),
    ])

    def work(batches):
        words, logs, seen = known.value
        vocabulary = pa.array(words, pa.large_string())
        row = TaskContext.get().partitionId() << 40
        for part in pieces(batches, text, SLICE):
            found, ends = words_of(part.column(1))
            docs_, n = part.num_rows, np.diff(ends)
            coded = found.dictionary_encode()
            entries, which = coded.dictionary, coded.indices.to_numpy()
            at = pc.fill_null(pc.index_in(entries, vocabulary), -1).to_numpy() if len(entries) else np.zeros(0, np.int64)
            symbol = np.where(at >= 0, at + 1, own + classes_of(entries)) if len(entries) else at
            tokens, doc = symbol[which], np.repeat(np.arange(docs_), n)
            frequent = tokens < own
            log = np.bincount(doc[frequent], logs[tokens[frequent]], minlength=docs_) + logs[0]
            many = np.bincount(doc[frequent], seen[tokens[frequent]], minlength=docs_).astype(np.int64) + int(seen[0])
            line = np.zeros(len(tokens) + docs_, kind)  # the end token after each text
            line[np.arange(len(tokens)) + doc] = tokens
            w = line.itemsize
            cuts, raw = ((ends + np.arange(docs_ + 1)) * w).tolist(), line.tobytes()
            nulls = lambda k, t: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + docs_)), part.column(0), part.column(2), pa.array(n + 1), pa.array(many), pa.array(log), pa.array([raw[x:y] for x, y in zip(cuts, cuts[1:])], pa.binary()), nulls(docs_, pa.string()), nulls(docs_, pa.list_(pa.int64())), nulls(docs_, pa.list_(pa.int64()))],
                names=[f.name for f in schema],
            )
            rest = np.flatnonzero(~frequent)
            if len(rest):
                pairs, times = np.unique(which[rest].astype(np.int64) * docs_ + doc[rest], return_counts=True)
                entry, owner = np.divmod(pairs, docs_)
                first = np.flatnonzero(np.diff(entry, prepend=-1))
                offsets, k = pa.array(np.append(first, len(entry)), pa.int32()), len(first)
                yield pa.RecordBatch.from_arrays(
                    [nulls(k, pa.int64()), nulls(k, part.column(0).type), nulls(k, pa.bool_()), nulls(k, pa.int64()), nulls(k, pa.int64()), nulls(k, pa.float64()), nulls(k, pa.binary()), entries.take(pa.array(entry[first])).cast(pa.string()), pa.ListArray.from_arrays(offsets, pa.array(row + owner)), pa.ListArray.from_arrays(offsets, pa.array(times))],
                    names=[f.name for f in schema],
                )
            row += docs_

    return docs.select(key, text, held).mapInArrow(work, schema)


class Blocks:
    """Blocks of some texts' symbols, the longest first: all advance together, one token a step."""

    def __init__(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.order = np.argsort(-size, kind="stable")
        start, self.size = start[self.order], size[self.order]
        self.active = np.bincount(self.size, minlength=int(self.size.max()) + 1)[::-1].cumsum()[::-1][1:]  # blocks of more than t tokens
        self.off = np.append(0, np.cumsum(self.active))
        t = np.repeat(np.arange(len(self.active)), self.active)
        self.symbols = symbols[start[np.arange(len(t)) - self.off[t]] + t]

    def forward(self, model: Model, enter: np.ndarray, first: np.ndarray):
        """Scaled distributions over states at every token, their scales, and the emissions. `enter`: the distribution before each block."""
        a, emit, ones = model.move, model.emit[self.symbols], np.ones(len(model.begin))
        alpha, scale = np.empty_like(emit), np.empty(len(emit))
        for t, n in enumerate(self.active):
            x = slice(self.off[t], self.off[t] + n)
            v = alpha[self.off[t - 1] : self.off[t - 1] + n] @ a if t else np.where(first[self.order][:, None], model.begin, enter[self.order] @ a)
            v *= emit[x]
            c = v @ ones
            alpha[x], scale[x] = v / c[:, None], c
        return alpha, scale, emit

    def last(self, values: np.ndarray) -> np.ndarray:
        """The value at each block's last token, in the order the blocks were given."""
        out = np.empty((len(self.size), *values.shape[1:]))
        out[self.order] = values[self.off[self.size - 1] + np.arange(len(self.size))]
        return out

    def logs(self, scale: np.ndarray) -> np.ndarray:
        """Natural logarithms of the blocks' likelihoods."""
        which = np.arange(len(scale)) - np.repeat(self.off[:-1], self.active)
        return np.bincount(which, np.log(scale), minlength=len(self.size))[np.argsort(self.order)]

    def transfer(self, model: Model) -> np.ndarray:
        """Products of all steps of each block, up to a factor."""
        s = len(model.begin)
        out = np.broadcast_to(np.eye(s), (len(self.size), s, s)).copy()
        for t, n in enumerate(self.active):
            m = (out[:n].reshape(-1, s) @ model.move).reshape(n, s, s)
            m *= model.emit[self.symbols[self.off[t] : self.off[t] + n]][:, None, :]
            if t % 8 == 7:
                m /= m.reshape(n, -1).max(axis=1)[:, None, None]
            out[:n] = m
        return out[np.argsort(self.order)]

    def count(self, model: Model, enter: np.ndarray, first: np.ndarray, leave: np.ndarray, into: Counts) -> None:
        """Adds expected counts; `leave`: the backward vector at each block's last token."""
        alpha, scale, emit = self.forward(model, enter, first)
        into.log += np.log(scale).sum()
        leave, first, enter = leave[self.order], first[self.order], enter[self.order]
        beta, moves = np.empty((0, len(model.begin))), np.zeros_like(model.move)
        emit /= scale[:, None]
        for t in range(len(self.active) - 1, -1, -1):
            n, x = self.active[t], slice(self.off[t], self.off[t + 1])
            now = leave[:n].copy()  # blocks that end here begin with it
            k = len(beta)
            if k:
                ahead = emit[self.off[t + 1] : self.off[t + 1] + k] * beta
                moves += alpha[x][:k].T @ ahead
                now[:k] = ahead @ model.move.T
            beta = now
            alpha_t = alpha[x]
            if not t:
                into.begin += (alpha_t * beta)[first].sum(axis=0)
                moves += enter[~first].T @ (emit[x] * beta)[~first]
            alpha_t *= beta  # from here on the expected states
        into.moves += moves * model.move
        for s in range(len(model.begin)):
            into.emit[:, s] += np.bincount(self.symbols, alpha[:, s], minlength=len(into.emit))


@dataclass
class Model:
    begin: np.ndarray  # by state
    move: np.ndarray  # from state to state
    emit: np.ndarray  # by symbol and state; of a class, for one of its words with c = 0

    def start_from(self) -> Counts:
        return Counts(np.zeros(len(self.begin)), np.zeros_like(self.move), np.zeros_like(self.emit), 0.0)


@dataclass
class Counts:
    begin: np.ndarray
    moves: np.ndarray
    emit: np.ndarray
    log: float

    def model(self, symbols: Symbols) -> Model:
        """The parameters of these counts and the pseudo-counts."""
        states = len(self.begin)
        emit = self.emit + symbols.slots[:, None] / states
        return Model(
            (self.begin + 1) / (self.begin + 1).sum(),
            (self.moves + 1) / (self.moves + 1).sum(axis=1, keepdims=True),
            emit / emit.sum(axis=0) / symbols.shares[:, None],
        )


def first_model(symbols: Symbols, states: int = STATES) -> Model:
    """Sticky states whose profiles differ by fixed factors between 1/4 and 4, drawn from each symbol's name."""
    names = [b"", *(w.encode() for w in symbols.words), *(b" %d" % i for i in range(CLASSES))]
    draw = np.array([[zlib.crc32(b"%d:" % s + w) / 2**32 for s in range(states)] for w in names])
    emit = (symbols.seen + symbols.slots)[:, None] * (4.0 ** (2 * draw - 1) if states > 1 else np.ones_like(draw))
    move = np.full((states, states), (1 - STICKY) / states) + np.eye(states) * STICKY
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0) / symbols.shares[:, None])


def _laid_out(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    body, ends = flat(column)
    return np.frombuffer(body.tobytes(), kind).astype(np.int64), ends // np.dtype(kind).itemsize


def _cut(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number in its text, start and size of every block."""
    n = np.diff(ends)
    many = -(-n // STEP)
    text = np.repeat(np.arange(len(n)), many)
    number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return text, number, ends[text] + number * STEP, np.minimum(STEP, n[text] - number * STEP)


def _groups(size: np.ndarray, some: np.ndarray):
    """Numbers of blocks in groups of about TOGETHER tokens."""
    if len(some):
        yield from np.split(some, np.flatnonzero(np.diff(np.cumsum(size[some]) // TOGETHER)) + 1)


def run_texts(model: Model, symbols: np.ndarray, ends: np.ndarray, into: Counts | None = None) -> np.ndarray | None:
    """Adds expected counts of the texts to `into`, or without it gives the natural logarithms of their likelihoods."""
    text, number, start, size = _cut(ends)
    states = len(model.begin)
    enter, leave = np.zeros((len(text), states)), np.ones((len(text), states))
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    heads = np.flatnonzero((number == 0) & ~last)  # of texts with several blocks
    if len(heads):
        done = np.zeros((len(text), states))
        for some in _groups(size, heads):
            b = Blocks(symbols, start[some], size[some])
            done[some] = b.last(b.forward(model, enter[some], np.ones(len(some), bool))[0])
        steps = np.empty((len(text), states, states))
        for some in _groups(size, np.flatnonzero(number > 0)):
            steps[some] = Blocks(symbols, start[some], size[some]).transfer(model)
        order = np.argsort(number, kind="stable")
        rounds = np.split(order, np.flatnonzero(np.diff(number[order])) + 1)
        for some in rounds[1:]:  # each text's next block
            enter[some] = done[some - 1]
            v = np.einsum("ij,ijk->ik", done[some - 1], steps[some])
            done[some] = v / v.sum(axis=1, keepdims=True)
        for some in reversed(rounds[1:]):
            v = np.einsum("ijk,ik->ij", steps[some], leave[some])
            leave[some - 1] = v / (v * done[some - 1]).sum(axis=1, keepdims=True)
    logs = np.zeros(len(text))
    for some in _groups(size, np.arange(len(text))):
        b = Blocks(symbols, start[some], size[some])
        if into is None:
            logs[some] = b.logs(b.forward(model, enter[some], number[some] == 0)[1])
        else:
            b.count(model, enter[some], number[some] == 0, leave[some], into)
    return np.bincount(text, logs, minlength=len(ends) - 1) if into is None else None


def _symbol_batches(batches, at: int, kind):
    """Slices of batches, with the symbols of their texts."""
    for batch in batches:
        symbols, ends = _laid_out(batch.column(at), kind)
        first = 0
        while first < batch.num_rows:
            stop = max(first + 1, int(np.searchsorted(ends, ends[first] + 2 * TOGETHER, "right")) - 1)
            yield batch.slice(first, stop - first), symbols[ends[first] : ends[stop]], ends[first : stop + 1] - ends[first]
            first = stop


def expected_counts(texts: DataFrame, model: Model, kind) -> Counts:
    """One pass over the training texts. Each task sends a row for each symbol it has met; Spark adds them up."""
    spark = texts.sparkSession
    size, states = model.emit.shape
    shared = spark.sparkContext.broadcast(model)  # symbols x states numbers
    columns = [f"v{s}" for s in range(states)]

    def work(batches):
        model, counts = shared.value, shared.value.start_from()
        for _, symbols, ends in _symbol_batches(batches, 0, kind):
            run_texts(model, symbols, ends, counts)
        log = np.zeros((1, states))
        log[0, 0] = counts.log
        rows = np.concatenate([counts.emit, counts.moves, counts.begin[None], log])
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(rows[some, s]) for s in range(states))], names=["at", *columns])

    # a task's counts are as large as the model: few tasks with many texts send less
    tasks = max(4 * spark.sparkContext.defaultParallelism, 1)
    found = texts.coalesce(tasks).mapInArrow(work, "at long, " + ", ".join(f"{c} double" for c in columns)).groupBy("at").agg(*(F.sum(c).alias(c) for c in columns))
    rows = np.zeros((size + states + 2, states))
    for at, *values in found.collect():  # at most FREQUENT_WORDS + CLASSES + states + 3 rows
        rows[at] = values
    return Counts(rows[size + states], rows[size : size + states], rows[:size], float(rows[-1, 0]))


@dataclass
class Fitted:
    symbols: Symbols
    model: Model
    logs: list[float]  # of the training texts before each round
    rows: DataFrame
    counts: DataFrame


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> Fitted:
    """Learns from the rows whose crc32 of the id, modulo 7, is not 2."""
    held = F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(False))
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), held.alias("held_out"))
    counts = stored(word_counts(docs.filter(~F.col("held_out")), "text"), "markov-words")
    symbols = symbols_of(counts)
    rows = stored(encoded(docs, symbols, "doc_id", "text", "held_out"), "markov-texts")
    kind = np.uint16 if symbols.size <= 1 << 16 else np.uint32
    training = rows.filter(F.col("_symbols").isNotNull() & ~F.col("held_out")).select("_symbols")
    model, logs = first_model(symbols, states), []
    for _ in range(rounds):
        found = expected_counts(training, model, kind)
        logs.append(found.log)
        model = found.model(symbols)
    return Fitted(symbols, model, logs, rows, counts)


def score(fitted: Fitted) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark, symbols = fitted.rows.sparkSession, fitted.symbols
    model = spark.sparkContext.broadcast(fitted.model)
    kind = np.uint16 if symbols.size <= 1 << 16 else np.uint32
    plain = ["_row", "doc_id", "held_out", "n_tokens", "_known", "_log"]

    def work(batches):
        for part, tokens, ends in _symbol_batches(batches, len(plain), kind):
            logs = run_texts(model.value, tokens, ends) / math.log(10)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(logs)], names=[*plain, "_model"])

    schema = T.StructType([*(fitted.rows.schema[c] for c in plain), T.StructField("_model", T.DoubleType())])
    texts = fitted.rows.filter(F.col("_symbols").isNotNull()).select(*plain, "_symbols").mapInArrow(work, schema)
    counts = fitted.counts.select(F.col("word").alias("_word"), "n")
    rare = fitted.rows.filter(F.col("_word").isNotNull()).select("_word", "_rows", "_times").join(counts, "_word", "left").select(F.explode(F.arrays_zip("_rows", "_times")).alias("_at"), "n")
    rare = rare.groupBy(F.col("_at._rows").alias("_row")).agg(
        F.sum(F.col("_at._times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("_rare_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("_at._times")).otherwise(0)).alias("_rare_known")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    weight = math.log10(symbols.total + symbols.distinct + 1)
    return texts.join(rare, "_row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("_known") + zero("_rare_known")).alias("n_known"),
        F.lit(symbols.total).cast("long").alias("train_tokens"),
        (F.col("_log") + zero("_rare_log") - F.col("n_tokens") * weight).alias("base_score"),
        (F.col("_model") + zero("_rare_log")).alias("score"),
    )


def markov_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Fits the model on the training rows and scores all rows."""
    return score(fit(docs, key, text, states, rounds))
