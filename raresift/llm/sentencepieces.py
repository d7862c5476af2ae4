"""Encoding and decoding with a SentencePiece BPE model by a max-plus parallel scan.

A sequence of pieces is the model's encoding exactly when its first piece encodes to itself and every two neighbours
encode to themselves. So an encoding is a path of positive weight through a lattice: edges are pieces, an edge may follow
another if the two are such neighbours, every edge weighs minus its number of ids, everything else minus
infinity. Texts are cut into chunks. A *boundary state* at a cut is the piece that ends there or reaches over it. Each
chunk yields, on its own, a max-plus matrix from the states at its start to those at its end. The matrices of a
document are combined associatively (a tree up, then down), which gives the true state at each cut and the number of ids
before it, and every chunk is then traced back on its own.

Pieces never reach over the start of a word or a character outside the vocabulary, so states at such places are one,
and the encoding between two of them is looked up in a bounded cache.

Defined cases: null and empty texts have no ids; equal rows give equal rows; further columns are not read; an
empty table gives an empty result; rows that share an id are kept apart.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from raresift.llm.text import keeps, prepare, tidy
from raresift.session import materialise

CHUNK_CHARS = 65_536
#: Words whose ids a worker keeps, and pairs of pieces it knows for each of them.
MOST_WORDS = 900_000
PAIRS_PER_WORD = 7 / 9
LONGEST_KEPT = 40
SPACE = "▁"
#: The state where nothing that stands before matters.
OPEN = 0
_MODELS: dict[tuple[str, int], "Model"] = {}
keeps("sentencepieces", _MODELS.clear)

State = int  # OPEN, or piece and overhang in one number


def _state(piece: int, over: int) -> State:
    return (piece + 1 << 8 | over) if piece >= 0 else -((-piece) << 8 | over)


def _parts(state: State) -> tuple[int | None, int]:
    if state == OPEN:
        return None, 0
    return ((state >> 8) - 1, state & 255) if state > 0 else (-((-state) >> 8), (-state) & 255)


class Model:
    """Vocabulary and pair rules. Characters outside the vocabulary are pieces with negative numbers."""

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        pieces = model.id_to_piece(list(range(count)))
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte: dict[int, int] = {}
        self.content: list[bytes] = []
        for number, piece in enumerate(pieces):
            if model.is_byte(number):
                value = int(piece[3:5], 16)
                self.byte[value] = number
                self.content.append(bytes([value]))
            elif model.is_control(number):
                self.content.append(b"")
            elif model.is_unknown(number):
                self.content.append(" ⁇ ".encode())
            else:
                if not model.is_unused(number):
                    self.ids[piece] = number
                    self.score[piece] = model.get_score(number)
                self.content.append(piece.replace(SPACE, " ").encode())
        self.pieces = pieces
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids))
        self.lengths = list(map(len, pieces))
        #: Every beginning of a piece: its number if it is a piece itself, else -1.
        self.beginnings = {piece[:size]: -1 for piece in self.ids for size in range(1, len(piece))} | self.ids
        self.breaks = "".join(c for c in map(chr, range(0x20)) if c not in self.ids)
        broken = re.escape(self.breaks)
        self.word = re.compile(f"[{broken}]|{SPACE}*[^{SPACE}{broken}]+|{SPACE}+")
        self.border = re.compile(f"(?<=[^{SPACE}])(?={SPACE})|(?<=[{broken}])|(?=[{broken}])")
        self.most_words, self.most_pairs = most_words, int(PAIRS_PER_WORD * most_words)
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The model's merging, best piece first, leftmost on a tie. For short strings."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for place in range(len(parts) - 1):
                score = self.score.get(parts[place] + parts[place + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, place
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def fits(self, before: int | None, piece: int) -> bool:
        """Whether ``piece`` may follow: the two encode to themselves."""
        if piece < 0:
            return True
        left = -1 if before is None or before < 0 else before
        key = left << 32 | piece
        known = self._pairs.get(key)
        if known is None:
            own = self.pieces[piece]
            first = [] if left < 0 else [self.pieces[left]]
            known = self.merge("".join([*first, own])) == [*first, own]
            if len(self._pairs) > self.most_pairs:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def spread(self, text: str, start: int, before: int | None, stop: int, limit: int) -> dict[int, tuple[int, int, int]]:
        """Best path to each place reached from ``start``: weight, last piece and where it begins.

        Pieces begin before ``stop`` and end at ``limit`` at the latest.
        """
        best: dict[int, tuple[int, int, int]] = {start: (0, -1 if before is None else before, -1)}
        beginnings, pairs = self.beginnings, self._pairs
        for place in range(start, stop):
            here = best.get(place)
            if here is None:
                continue
            weight, last, origin = here
            key = -1 if origin < 0 and before is None or last < 0 else last
            weight -= 1
            end = place
            while end < limit:
                end += 1
                piece = beginnings.get(text[place:end])
                if piece is None:
                    break
                if piece < 0:
                    continue
                good = pairs.get(key << 32 | piece)
                if good is None:
                    good = self.fits(None if key < 0 else key, piece)
                if good and (end not in best or best[end][0] < weight):
                    best[end] = (weight, piece, place)
            if text[place] not in self.ids:
                cost = len(text[place].encode()) if self.byte else 1
                if place + 1 not in best or best[place + 1][0] < weight + 1 - cost:
                    best[place + 1] = (weight + 1 - cost, ~ord(text[place]), place)
        return best

    def back(self, best: dict[int, tuple[int, int, int]], end: int) -> list[int]:
        """Ids of the path to ``end``."""
        found: list[int] = []
        while best[end][2] >= 0:
            _, piece, end = best[end]
            found.extend(reversed(self.numbers(piece)))
        found.reverse()
        return found

    def numbers(self, piece: int) -> list[int]:
        if piece >= 0:
            return [piece]
        return [self.byte[value] for value in chr(~piece).encode()] if self.byte else [self.unknown]

    def only_path(self, word: str) -> list[int] | None:
        """The path through a word, longest pieces first; none where characters lie outside the vocabulary.

        A beginning of a word has one encoding, so a place is reached on one path only: the search never enters a place
        twice, and the path that it finds is the one of ``spread``.
        """
        size, beginnings, pairs, lengths = len(word), self.beginnings, self._pairs, self.lengths
        entered = {0}
        found: list[int] = []
        waiting: list[tuple[int, list[int]]] = []
        place, last = 0, -1
        while place < size:
            if beginnings.get(word[place], -1) < 0:
                return None
            options = []
            for end in range(place + 1, size + 1):
                piece = beginnings.get(word[place:end])
                if piece is None:
                    break
                if piece >= 0:
                    options.append(piece)
            while True:
                if options:
                    piece = options.pop()
                    end = place + lengths[piece]
                    if end in entered:
                        continue
                    good = pairs.get(last << 32 | piece)
                    if good is None:
                        good = self.fits(None if last < 0 else last, piece)
                    if good:
                        break
                elif found:
                    found.pop()
                    last = found[-1] if found else -1
                    place, options = waiting.pop()
                else:
                    return None
            entered.add(end)
            waiting.append((place, options))
            found.append(piece)
            place, last = end, piece
        return found

    def _word(self, word: str) -> bytes:
        found = self.only_path(word)
        if found is None:
            found = self.back(self.spread(word, 0, None, len(word), len(word)), len(word))
        packed = np.array(found, np.uint32).tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self._words) > self.most_words:
                self._words.clear()
            self._words[word] = packed
        return packed

    def body(self, text: str) -> bytes:
        """Packed ids of a text between two open places."""
        known = self._words
        words = self.word.findall(text)
        try:
            return b"".join([known[word] for word in words])
        except KeyError:
            return b"".join([known.get(word) or self._word(word) for word in words])

    def is_open(self, text: str, place: int) -> bool:
        if place <= 0 or place >= len(text):
            return True
        a, b = text[place - 1], text[place]
        return (a != SPACE and b == SPACE) or a in self.breaks or b in self.breaks

    def states(self, text: str, cut: int, edge: bool) -> list[State]:
        """Boundary states that the text around a cut allows."""
        if edge or self.is_open(text, cut):
            return [OPEN]
        found = []
        for start in range(max(0, cut - self.longest), cut):
            for end in range(cut, min(len(text), start + self.longest) + 1):
                piece = self.ids.get(text[start:end])
                if piece is not None:
                    found.append(_state(piece, end - cut))
        if text[cut - 1] not in self.ids:
            found.append(_state(~ord(text[cut - 1]), 0))
        return found


@dataclass
class Chunk:
    """A part of a text with some context: the chunk is ``text[low:high]``."""

    text: str
    low: int
    high: int
    first: bool
    last: bool

    def borders(self, model: Model) -> tuple[int | None, int]:
        """First and last open place in the chunk."""
        start = self.low if self.first or model.is_open(self.text, self.low) else None
        if start is None:
            match = model.border.search(self.text, self.low + 1, self.high)
            start = match.start() if match else None
            if start is None and (self.last or model.is_open(self.text, self.high)):
                start = self.high
        if start is None:
            return None, 0
        if self.last or model.is_open(self.text, self.high):
            return start, self.high
        stop = start
        at = max(start, self.high - 4096)
        while True:
            for match in model.border.finditer(self.text, at, self.high):
                stop = max(stop, match.start())
            if stop > start or at <= start:
                return start, stop
            at = max(start, at - (self.high - at) * 4)

    def _tail(self, model: Model, place: int, before: int | None) -> tuple[dict, dict[State, int]]:
        """Paths from a place to the end of the chunk, and the place each end state stands for."""
        limit = self.high if self.last else len(self.text)
        best = model.spread(self.text, place, before, self.high, limit)
        if self.last or model.is_open(self.text, self.high):
            return best, {OPEN: self.high} if self.high in best else {}
        return best, {_state(best[end][1], end - self.high): end for end in best if end >= self.high and best[end][2] >= 0}

    def matrix(self, model: Model) -> list[tuple[State, State, int]]:
        """Reachable pairs of a start and an end state with their weight; all others are minus infinity."""
        start, stop = self.borders(model)
        entries = model.states(self.text, self.low, self.first)
        rows: list[tuple[State, State, int]] = []
        if start is None:
            for entry in entries:
                piece, over = _parts(entry)
                if self.low + over >= self.high:
                    if not self.last and self.low + over > self.high:
                        rows.append((entry, _state(piece, self.low + over - self.high), 0))
                    elif self.low + over == self.high:
                        rows.append((entry, _state(piece, 0), 0))
                    continue
                best, ends = self._tail(model, self.low + over, piece)
                rows += [(entry, state, best[end][0]) for state, end in ends.items()]
            return rows
        inner = -(len(model.body(self.text[start:stop])) // 4)
        if stop < self.high:
            best, ends = self._tail(model, stop, None)
            tails = [(state, best[end][0]) for state, end in ends.items()]
        else:
            tails = [(OPEN, 0)]
        for entry in entries:
            piece, over = _parts(entry)
            head = model.spread(self.text, self.low + over, piece, start, start) if self.low + over <= start else {}
            if start in head:
                rows += [(entry, state, head[start][0] + inner + weight) for state, weight in tails]
        return rows

    def trace(self, model: Model, entry: State, exit_: State) -> bytes:
        """Packed ids of the pieces that begin in the chunk, on the path between the two states."""
        start, stop = self.borders(model)
        piece, over = _parts(entry)
        place = self.low + over
        if start is None:
            if place >= self.high:
                return b""
            best, ends = self._tail(model, place, piece)
            return np.array(model.back(best, ends[exit_]), np.uint32).tobytes()
        head = model.back(model.spread(self.text, place, piece, start, start), start)
        tail: list[int] = []
        if stop < self.high:
            best, ends = self._tail(model, stop, None)
            tail = model.back(best, ends[exit_])
        return np.array(head, np.uint32).tobytes() + model.body(self.text[start:stop]) + np.array(tail, np.uint32).tobytes()


def load(path: str, most_words: int = MOST_WORDS) -> Model:
    key = (path, most_words)
    if key not in _MODELS:
        _MODELS[key] = Model(path, most_words)
    return _MODELS[key]


def normal(text: str) -> str:
    """The text as the model sees it: spaces written out, one put in front."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def split(text: str, size: int, context: int) -> Iterator[Chunk]:
    for start in range(0, len(text), size):
        end = min(len(text), start + size)
        left = max(0, start - context)
        yield Chunk(text[left : end + context], start - left, end - left, start == 0, end == len(text))


Matrix = dict[State, dict[State, int]]


def compose(left: Matrix, right: Matrix) -> Matrix:
    """The max-plus product."""
    made: Matrix = {}
    for entry, row in left.items():
        sums: dict[State, int] = {}
        for middle, weight in row.items():
            for end, more in right.get(middle, {}).items():
                if end not in sums or sums[end] < weight + more:
                    sums[end] = weight + more
        if sums:
            made[entry] = sums
    return made


def scan(matrices: list[Matrix]) -> list[tuple[State, State, int]]:
    """Per chunk: its true start and end state, and the weight of all chunks before it.

    Products are combined up a tree; going down it, each node splits its path at the best state in its middle.
    """
    levels = [matrices]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([compose(*below[i : i + 2]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
    paths: list[tuple[State, State, int]] = [(OPEN, OPEN, 0)]
    if OPEN not in levels[-1][0] or OPEN not in levels[-1][0][OPEN]:
        raise ValueError("no encoding leads through the text")
    for below in reversed(levels[:-1]):
        down: list[tuple[State, State, int]] = []
        for place, (entry, end, weight) in enumerate(paths):
            pair = below[2 * place : 2 * place + 2]
            if len(pair) == 1:
                down.append((entry, end, weight))
                continue
            options = ((w + pair[1][m][end], -m, m, w) for m, w in pair[0][entry].items() if end in pair[1].get(m, {}))
            _, _, middle, first = max(options)
            down += [(entry, middle, weight), (middle, end, weight + first)]
        paths = down
    return paths


def decode(model: Model, ids: np.ndarray | list[int]) -> str:
    """Text of the ids, without the space put in front."""
    text = b"".join([model.content[number] for number in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _parts_encoded(
    docs: DataFrame, model_path: str, chunk_chars: int, id_col: str, text_col: str, most_words: int, checked: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Encoded rows of the texts of one chunk (with checks, if wished), and of the chunks of longer texts.

    A text of one chunk needs no other and is encoded where it is read; chunks of longer ones are dealt out.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    chosen = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    short = F.char_length("text") < chunk_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path, most_words)
        for batch in batches:
            ids = []
            for value in batch.column(2):
                content = normal(value.as_py())
                ids.append(Chunk(content, 0, len(content), True, True).trace(model, OPEN, OPEN) if content else b"")
            if checked:
                yield _checked(model, batch.column(0), pa.array(np.ones(len(ids), np.int32)), ids)
                continue
            zeros = np.zeros(len(ids), np.int64)
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            arrays = [batch.column(0), batch.column(1), pa.array(zeros.astype(np.int32)), pa.array(zeros), counts]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.binary())], names=NAMES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path, most_words)
        for batch in batches:
            for doc_id, row, value in zip(*batch.columns, strict=True):
                for number, part in enumerate(split(normal(value.as_py()), chunk_chars, model.longest + 1)):
                    yield pa.RecordBatch.from_pylist(
                        [{"doc_id": doc_id.as_py(), "row": row.as_py(), "chunk": number, **vars(part)}], PARTS
                    )

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path, most_words)
        for batch in batches:
            for entry in batch.to_pylist():
                rows = _chunk(entry).matrix(model)
                key = {name: entry[name] for name in ("row", "chunk")}
                yield pa.RecordBatch.from_pylist(
                    [{**key, "entry": a, "leave": b, "weight": w} for a, b, w in rows],
                    pa.schema([(n, pa.int32() if n == "chunk" else pa.int64()) for n in MATRIX]),
                )

    def combine(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts: list[Matrix] = [{} for _ in range(1 + max(row["chunk"] for row in rows))]
        for row in rows:
            parts[row["chunk"]].setdefault(row["entry"], {})[row["leave"]] = row["weight"]
        paths = scan(parts)
        count = len(paths)
        return pa.table(
            {
                "row": pa.array([rows[0]["row"]] * count, pa.int64()),
                "chunk": pa.array(range(count), pa.int32()),
                "entry": pa.array([a for a, _, _ in paths], pa.int64()),
                "leave": pa.array([b for _, b, _ in paths], pa.int64()),
                "before": pa.array([-w for _, _, w in paths], pa.int64()),
            }
        )

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path, most_words)
        for batch in batches:
            rows = []
            for entry in batch.to_pylist():
                ids = _chunk(entry).trace(model, entry["entry"], entry["leave"])
                key = {name: entry[name] for name in ("doc_id", "row", "chunk", "before")}
                rows.append({**key, "n_tokens": len(ids) // 4, "ids": ids})
            yield pa.RecordBatch.from_pylist(rows, FOUND)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = chosen.filter(~short).mapInArrow(tidy("sentencepieces", cut), _ddl(PARTS)).repartition(partitions, "row", "chunk")
    chunks = materialise(parts)
    links = chunks.mapInArrow(tidy("sentencepieces", matrices), ", ".join(f"{n} {'int' if n == 'chunk' else 'bigint'}" for n in MATRIX))
    paths = links.groupBy("row").applyInArrow(combine, "row bigint, chunk int, entry bigint, leave bigint, before bigint")
    joined = chunks.join(paths, ["row", "chunk"]).select(chunks["*"], "entry", "leave", "before")
    return chosen.filter(short).mapInArrow(tidy("sentencepieces", whole), CHECKED if checked else _ddl(FOUND)), joined.mapInArrow(tidy("sentencepieces", traced), _ddl(FOUND))


def encode_chunks(
    docs: DataFrame,
    model_path: str,
    chunk_chars: int = CHUNK_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """``doc_id, row, chunk, before, n_tokens, ids``: ids of each chunk; ``before`` counts those of earlier chunks.

    ``row`` tells rows of one id apart. Ids are packed as unsigned 32-bit numbers.
    """
    short, long = _parts_encoded(docs, model_path, chunk_chars, id_col, text_col, most_words)
    return short.unionByName(long)


NAMES = ["doc_id", "row", "chunk", "before", "n_tokens", "ids"]
MATRIX = ("row", "chunk", "entry", "leave", "weight")
FOUND = pa.schema(
    [("doc_id", pa.int64()), ("row", pa.int64()), ("chunk", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()),
     ("ids", pa.binary())]
)
PARTS = pa.schema(
    [("doc_id", pa.int64()), ("row", pa.int64()), ("chunk", pa.int32()), ("text", pa.string()), ("low", pa.int32()),
     ("high", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())]
)


def _ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "bigint", "int32": "int", "bool": "boolean"}
    return ", ".join(f"{field.name} {kinds.get(str(field.type), field.type)}" for field in schema)


def _chunk(entry: dict) -> Chunk:
    return Chunk(entry["text"], entry["low"], entry["high"], entry["first"], entry["last"])


def encode(
    docs: DataFrame,
    model_path: str,
    chunk_chars: int = CHUNK_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """``doc_id, n_chunks, n_tokens, ids, ids_crc32, text_crc32``: a row per document with all its ids.

    ``text_crc32`` is the check of the decoded ids, equal to the check of the text where decoding gives it back.
    ``most_words`` trades memory of the workers against time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path, most_words)
        for batch in batches:
            yield _checked(model, batch.column(0), batch.column(1), batch.column(2).to_pylist())

    single, long = _parts_encoded(docs, model_path, chunk_chars, id_col, text_col, most_words, checked=True)
    # One text's chunks come together here: it is a row of the result.
    gathered = long.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    empty = F.lit(bytearray()).cast("binary")
    several = gathered.select(
        "doc_id",
        F.size("parts").alias("n_chunks"),
        F.aggregate("parts", empty, lambda done, part: F.concat(done, part["ids"])).alias("ids"),
    )
    return single.unionByName(several.mapInArrow(tidy("sentencepieces", run), CHECKED))


CHECKED = "doc_id bigint, n_chunks int, n_tokens bigint, ids binary, ids_crc32 bigint, text_crc32 bigint"


def _checked(model: Model, doc_ids: pa.Array, chunks: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
    """Rows of documents with the checks of their ids and of the decoded text."""
    counts = pa.array([len(content) // 4 for content in ids], pa.int64())
    checks = pa.array([zlib.crc32(content) for content in ids], pa.int64())
    decoded = (decode(model, np.frombuffer(content, np.uint32).tolist()) for content in ids)
    texts = pa.array([zlib.crc32(text.encode()) for text in decoded], pa.int64())
    arrays = [doc_ids, chunks, counts, pa.array(ids, pa.binary()), checks, texts]
    return pa.RecordBatch.from_arrays(arrays, names=[entry.split()[0] for entry in CHECKED.split(", ")])
