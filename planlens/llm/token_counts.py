"""Token counts by a finite-state transducer made from a BPE vocabulary with scores.

The transducer reads characters. Its state holds what later tokens can depend on: each suffix of the text read that
begins some longer token, with the last token before that suffix and the number of tokens from there on. A transition
carries the number of tokens that the character adds to (or, by merging, takes from) the count. States and transitions
are made when first met; from then on a character costs one lookup. The table is emptied when it reaches MOST_STATES.

Long texts are cut into chunks that are mapped in separate tasks. A chunk's map says, for each state that it may be
entered in, the state that it is left in and the tokens that it adds; maps compose associatively, and a scan over a
text's maps gives its count. The states that a chunk may be entered in come from the characters before it: the
transducer is started at each of several places there, far enough back that a start at the true token boundary has
forgotten what came before. Where states meet, their runs go on as one, so ordinary text costs one run and only strictly
periodic text (a long line of one sign) several. A space after another character puts every state into the same one,
since no token holds a space after another character (checked when the model is read); there the parts between
such places are counted from a table. Should a chunk be entered in a state that its map lacks, it is read again from the
shared folder and run from that state, so counts are exact in any case. Only maps, not texts, are shuffled.

Defined results: null and empty texts have 0 bytes and 0 tokens; null ids are carried; repeated rows are counted one by
one; an empty table gives no rows; extra columns are ignored; characters without a token count as their UTF-8 bytes.
"""

from __future__ import annotations

import pickle
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlens.llm.common import opener, shared_dir, ship, shipped, text_of, written

#: Characters of a text that one task maps at once; states and parts that are kept.
CHUNK, MOST_STATES, MOST_PARTS, LONGEST = 1 << 20, 300_000, 250_000, 48
#: Characters that are run between two looks at whether states have met; between two at the size of the table.
STRIDE, LOOK = 64, 1 << 16
GAP = "▁"


class _State(dict):
    """Transitions by character: (next state, tokens added)."""

    __slots__ = ("machine", "after_gap", "live")

    @property
    def key(self) -> tuple:
        return self.after_gap, self.live

    def __missing__(self, c: str):
        return self.machine.extend(self, c)


class Transducer:
    """Counts tokens as the model's library does, for BPE with byte fallback, a space put first and no other changes."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
        self.score = {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not special(i)}
        if any(re.search(f"[^{GAP}]{GAP}", p) for p in self.score):
            raise ValueError("a token holds a space after another character")
        self.longest = max(map(len, self.score))
        self.begins = {p[:k] for p in self.score for k in range(1, len(p))}
        self.pairs: dict = {}
        self._clear()

    def _clear(self) -> None:
        self.states: dict = {}
        self.parts: dict = {}
        self.first = self._state(True, (("", None, 0),))

    def _state(self, after_gap: bool, live: tuple) -> _State:
        if (s := self.states.get((after_gap, live))) is None:
            s = self.states[after_gap, live] = _State()
            s.machine, s.after_gap, s.live = self, after_gap, live
        return s

    def _merged(self, text: str) -> list[str]:
        """The tokens of a short text by merging the best pair, the leftmost of equals, again and again."""
        a = list(text)
        while len(a) > 1:
            best = max(((s, -i) for i in range(len(a) - 1) if (s := self.score.get(a[i] + a[i + 1])) is not None), default=None)
            if best is None:
                break
            a[-best[1] : 2 - best[1]] = [a[-best[1]] + a[1 - best[1]]]
        return a

    def _follows(self, last: str | None, token: str) -> bool:
        """Whether the token stays a token of its own after last."""
        if (ok := self.pairs.get((last, token))) is None:
            if len(self.pairs) > 2 * MOST_STATES:
                self.pairs.clear()
            ok = self.pairs[last, token] = self._merged((last or "") + token) == ([token] if last is None else [last, token])
        return ok

    def extend(self, state: _State, c: str):
        x = GAP if c == " " else c
        if x == GAP and not state.after_gap:
            step = (self.first[GAP][0], 1)
        else:
            for suffix, last, n in state.live:
                token = suffix + x
                if token in self.score:
                    if self._follows(last, token):
                        n += 1
                        break
                elif not suffix:
                    n += len(x.encode("utf-8", "replace"))
                    break
            else:
                raise ValueError(f"no token ends with {x!r}")
            live = tuple((s + x, t, k - n) for s, t, k in state.live if s + x in self.begins)
            step = (self._state(x == GAP, (*live, ("", token, 0))), n)
        state[c] = step
        return step

    def run(self, text: str) -> int:
        """Tokens of a text whose first character is read in the first state."""
        s, n = self.first, 0
        for c in text:
            s, k = s[c]
            n += k
        return n

    def part(self, part: str) -> int:
        """Tokens of a part that begins with a gap; the counts of short parts are kept."""
        n = self.run(part)
        if len(part) <= LONGEST:
            self.parts[part] = n
        return n

    def tidy(self) -> None:
        if len(self.states) > MOST_STATES:
            self._clear()
        elif len(self.parts) > MOST_PARTS:
            self.parts.clear()

    def _inner(self, chunk: str, cut: list[int]) -> int:
        """Tokens between the first and the last of the chunk's gaps after other characters."""
        kept, n, inner = self.parts, 0, chunk[cut[0] : cut[-1]]
        if len(cut) > 1:
            pieces = inner.split(" ")  # the first is empty, since a gap comes first
            if "" in pieces[1:] or GAP in inner:
                pieces = _PARTS.findall(inner)
            else:
                del pieces[0]
                pieces = [" " + p for p in pieces]
            for p in pieces:
                if (k := kept.get(p)) is None:
                    k = self.part(p)
                n += k
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text; a gap is read first."""
        if not text:
            return 0
        cut = [m.start() + 1 for m in _RESET.finditer(text)]
        if not cut:
            return self.run(GAP + text)
        return self.run(GAP + text[: cut[0]]) + self._inner(text, cut) + self.run(text[cut[-1] :])

    def read(self, state: _State, text: str) -> tuple[_State, int]:
        """The state that a text leads to, and the tokens that it adds."""
        n = 0
        for a in range(0, len(text), LOOK):
            if len(self.states) > MOST_STATES:
                self._clear()
                state = self._state(*state.key)
            for c in text[a : a + LOOK]:
                state, k = state[c]
                n += k
        return state, n

    def entries(self, before: str, whole: bool) -> list[tuple]:
        """States that what follows these characters may be entered in; the one state where they are all that comes before."""
        if whole:
            return [self.read(self.first, GAP + before)[0].key]
        starts = range(min(self.longest, len(before)) + 1)
        return list(dict.fromkeys(self.read(self.first, before[a:])[0].key for a in starts))

    def map_of(self, chunk: str, entries: list[tuple]) -> dict:
        """{state entered: (state left, tokens added)}."""
        cut = [m.start() + 1 for m in _RESET.finditer(chunk)]
        if cut:
            n = self._inner(chunk, cut)
            left, k = self.read(self.first, chunk[cut[-1] :])
            return {e: (left.key, self.read(self._state(*e), chunk[: cut[0]])[1] + n + k) for e in entries}
        now = {e: (e, 0) for e in entries}
        for a in range(0, len(chunk), STRIDE):
            if len({s for s, _ in now.values()}) == 1:  # they have met
                (s, _), = {(s, 0) for s, _ in now.values()}
                left, k = self.read(self._state(*s), chunk[a:])
                return {e: (left.key, n + k) for e, (_, n) in now.items()}
            step = {s: self.read(self._state(*s), chunk[a : a + STRIDE]) for s in {s for s, _ in now.values()}}
            now = {e: (step[s][0].key, n + step[s][1]) for e, (s, n) in now.items()}
        return now

    @staticmethod
    def compose(a: dict, b: dict) -> dict:
        """The map of a and then b; associative. States that lead to one that b lacks are left out."""
        return {e: (b[s][0], n + b[s][1]) for e, (s, n) in a.items() if s in b}

    def scan(self, maps: list[dict]) -> dict:
        """All maps composed, pairs of neighbours first."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def total(self, maps: list[dict], chunk_at) -> int:
        """Tokens of a text with these maps of its chunks; chunk_at(k) gives a chunk whose map lacks the state it is entered in."""
        start = next(iter(maps[0]))
        if start in (whole := self.scan(maps)):
            return whole[start][1]
        s, n = start, 0
        for k, m in enumerate(maps):
            if s not in m:
                m = self.map_of(chunk_at(k), [s])
            s, more = m[s]
            n += more
        return n


#: Where a gap follows another character; a gap and what follows it.
_RESET = re.compile(f"[^ {GAP}](?=[ {GAP}])")
_PARTS = re.compile(f"[ {GAP}]+[^ {GAP}]+")

_MADE: dict = {}


def transducer(path: str) -> Transducer:
    """One for each model and Python worker."""
    if path not in _MADE:
        _MADE.clear()
        _MADE[path] = Transducer(path)
    return _MADE[path]


def _maps(path: str):
    """Pickled maps of chunks (row, id, n_bytes, k, before, text); a text's first chunk is entered in the first state, with a gap."""

    def run(batches):
        t = transducer(shipped(path))
        for b in batches:
            maps = []
            for k, before, text in zip(b["k"], b["before"], b["text"]):
                if k == 0:
                    maps.append(t.map_of(GAP + text, [t.first.key]))
                else:
                    maps.append(t.map_of(text, t.entries(before[1:], before[0] == "^")))
                t.tidy()
            yield b[["row", "id", "n_bytes", "k"]].assign(map=[pickle.dumps(m) for m in maps])

    return run


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and n_tokens of every row. Long texts' chunks are written to the shared folder, and their maps shuffled."""
    ship(docs.sparkSession, path)

    def whole(batches):
        t = transducer(shipped(path))
        for b in batches:
            n = []
            for text in b["text"]:
                n.append(t.count(text))
                t.tidy()
            yield b[["id", "n_bytes"]].assign(n_tokens=pd.Series(n, b.index, dtype="int64"))

    def cut(batches):
        reach = 3 * transducer(shipped(path)).longest
        for b in batches:
            for row, id_, n_bytes, text in zip(b["row"], b["id"], b["n_bytes"], b["text"]):
                for a in range(0, len(text), chunk):
                    # The characters before a chunk, marked if they are all there are.
                    before = ("^" if a <= reach else ".") + text[max(a - reach, 0) : a]
                    yield pd.DataFrame({"row": [row], "id": pd.Series([id_], dtype="Int64"), "n_bytes": [n_bytes], "k": [a // chunk], "before": [before], "text": [text[a : a + chunk]]})

    text, id_ = text_of(text_col), F.col(id_col).cast("long").alias("id")
    d = docs.select(id_, F.monotonically_increasing_id().alias("row"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    # A text has no more characters than bytes, so most aren't counted.
    long = (F.col("n_bytes") > chunk) & (F.length("text") > chunk)
    short = d.where(~long).select("id", "n_bytes", "text").mapInPandas(whole, "id long, n_bytes long, n_tokens long")
    at = shared_dir(docs.sparkSession)
    chunks = written(d.where(long).mapInPandas(cut, "row long, id long, n_bytes long, k int, before string, text string"), at)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    maps = chunks.repartition(parts, "row", "k").mapInPandas(_maps(path), "row long, id long, n_bytes long, k int, map binary")
    maps = maps.groupBy("row", "id", "n_bytes").agg(F.sort_array(F.collect_list(F.struct("k", "map"))).alias("maps"))

    def finish(batches):
        for b in batches:
            n = []
            for row, maps in zip(b["row"], b["maps"]):
                n.append(transducer(shipped(path)).total([pickle.loads(m["map"]) for m in maps], lambda k, row=row: _chunk_at(at, row, k)))
            yield b[["id", "n_bytes"]].assign(n_tokens=pd.Series(n, b.index, dtype="int64"))

    return short.unionByName(maps.mapInPandas(finish, "id long, n_bytes long, n_tokens long")).withColumnRenamed("id", id_col)


def _chunk_at(at: str, row: int, k: int) -> str:
    """A chunk read from the shared folder."""
    import pyarrow.dataset as ds

    fs, root = opener(at)
    where = (ds.field("row") == row) & (ds.field("k") == k)
    return ds.dataset(root, filesystem=fs, format="parquet").to_table(columns=["text"], filter=where)["text"][0].as_py()


def op8(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    return count_tokens(docs, path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
