"""Problem 4: repair of text from scanned pages by averaged perceptrons.

Three decisions are learned from the collection itself, without given labels. Lines: furniture (running headers,
footers, page numbers) or text, from position on the page and from how often and where a line's template recurs; the
seeds are lines for which these agree. Line ends: join, join with the hyphen, or leave, from counts of the joined and of
the hyphenated word. Characters: keep, replace, delete or insert. Which replacements there are is learned, too: words are
aligned with much more frequent ones that differ in one place, and what is read there for what is written counts as an
operation if it is seen often and its reverse is not. The character editor then scores the operations at all places of a word by
the operation, its neighbours and the counts of the word as read and as repaired. Counts, operations and perceptrons rest
on all pages and all words.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletloom.llm.perceptron import Perceptron, fit, in_proportion
from tabletloom.session import cut, spread

#: Examples in the proportions of all that lines and line ends are fitted on, where few different ones occur.
SEEDS = 6_000
#: For the seeds: a repaired word is so many times as frequent as the word as read, and occurs so often. A word as read that
#: itself occurs so often (as every misreading does in a large collection) is ``FAR`` times as rare.
RATIO, KNOWN, FAR = 8, 4, 20
#: An operation is seen in so many words, with such a share of the commonest, and so many times as often as its reverse.
TIMES, SHARE, ONE_WAY = 3, 0.03, 4
#: Words beyond this length are repaired place by place, each from its neighbourhood, as no other writing of them is known.
LONG, AROUND = 200, 20
#: Templates up to which the table of recurring ones is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
_TOKEN = re.compile(r"[^\s.,;:()\[\]\"“”„«»…]+")
_NUMBER = re.compile(r"[-–—\[(|\s]*(?:[\dlIO|!]*\d[\dlIO|!]*|[lIO!|]{1,3}|[ivxl]{1,7})[-–—\])|.\s]*")
_HEADING = re.compile(r"\s*t[ec]x[tf]\s+[\dlIO]+[a-z]?[.:]?\s*", re.IGNORECASE)
_STOPS = ".,;:!?-\u00ad\u00ac"
_MARKS = "-­¬"
_SURE = "!?"  # at a word's end these are no letters


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def template(line: str) -> str:
    """A line without its numbers, case and the differences that misreading makes."""
    s = re.sub(r"(?<![^\W\d_])[lIO|!\d]*\d[lIO|!\d]*(?![^\W\d_])|(?<!\S)[lIO!|]{1,3}(?![^\s.,;:)\]])", "#", line.strip())
    s = re.sub(r"\s+", " ", s).lower()
    for a, b in (("rn", "m"), ("cl", "d"), ("ii", "n"), ("vv", "w"), ("u", "n")):
        s = s.replace(a, b)
    return s.translate(str.maketrans("chf!15069ſ§|jb8", "ebtilsobgsslibb"))


def places(lines: list[str]) -> list[str]:
    """Where each line stands among the page's lines that are not blank."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    out = ["blank"] * len(lines)
    for k, i in enumerate(full):
        out[i] = "first" if k == 0 else "last" if k == len(full) - 1 else "second" if k == 1 else "fore" if k == len(full) - 2 else "mid"
    return out


def line_features(line: str, place: str, number: bool, before: bool | None, after: bool | None, recurring: str) -> tuple:
    """What the decision on a line rests on; few different ones occur."""
    s = line.strip()
    return (
        place, number, before, after, recurring, min(len(s) // 10, 6), bool(_HEADING.fullmatch(s)), s.upper() == s and s.lower() != s,
        s[:1].isdigit(), s[-1:].isdigit(), s[-1:] in _STOPS, s[:1].islower(),
    )


def line_options(f: tuple) -> list[tuple[str, list[str]]]:
    place, number, before, after, recurring, size, heading, upper, first, last, stop, low = f
    names = [
        "bias", f"place={place}", f"number={number}", f"number={number},place={place}", f"recurring={recurring}",
        f"recurring={recurring},place={place}", f"size={size}", f"heading={heading}", f"upper={upper}",
        f"digits={first}{last}", f"stop={stop}", f"small={low}", f"beside={number},{before}{after}",
    ]
    return [("text", names), ("furniture", names)]


def _strings(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    for i, t in zip(batch.column("row_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        yield i, t.split("\n")


def _pages(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("row_id"), F.col(text_column).cast("string").alias("text")).where("text is not null and text <> ''")


def may_be_header(line: str) -> bool:
    """Headers are short, begin with a number or a capital and end without a stop; headings and numbers are others."""
    s = line.strip()
    words = s.split()
    start = words[1] if len(words) > 1 and _NUMBER.fullmatch(words[0]) else s
    return len(s) < 80 and s[-1:] not in _STOPS and not start[:1].islower() and not _HEADING.fullmatch(s) and not _NUMBER.fullmatch(s)


def _wildcards(t: Column) -> Column:
    """Hashes of a template with each one of its characters left open."""
    one = lambda i: F.xxhash64(F.substring(t, F.lit(1), i - 1), i, F.substring(t, i + 1, F.length(t)))
    return F.transform(F.sequence(F.lit(1), F.length(t)), one)


def recurring_lines(pages: DataFrame) -> DataFrame:
    """(k1, k2, marks): of each page, by the hashes of its text, the lines whose template recurs: line and how it does
    ("often", "some", or "near" to one that often does)."""

    def lines_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, at, t, edge = [], [], [], [], []
            for a, b, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines = text.split("\n")
                for k, (line, place) in enumerate(zip(lines, places(lines), strict=True)):
                    if place != "blank" and may_be_header(line):
                        k1.append(a)
                        k2.append(b)
                        at.append(k)
                        t.append(template(line))
                        edge.append(int(place != "mid"))
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(at, pa.int32()), pa.array(t, pa.string()), pa.array(edge, pa.int32())], names=["k1", "k2", "at", "t", "edge"])

    # a page that was loaded several times counts once: its lines do not recur
    lines = cut(pages.select("k1", "k2", "text").mapInArrow(lines_out, "k1 long, k2 long, at int, t string, edge int").dropDuplicates(["k1", "k2", "at"]))
    counts = cut(lines.groupBy("t").agg(F.count("*").alias("n"), F.sum("edge").alias("edge")).where("edge > 0"))
    # text lines stand at the edge by chance only; a header does so on most of its pages. In a large collection many text
    # lines recur, so the share at the edge is taken at the lower end of its 95 % interval (Wilson)
    recurs = F.expr("n >= 3 and (edge + 2 - 2 * sqrt(edge * (n - edge) / n + 1)) / (n + 4) >= 0.4")
    known = counts.where(recurs).select("t", F.when(F.col("n") >= 12, "often").otherwise("some").alias("how"))
    long = F.length("t") > 8
    often = cut(known.where(long & (F.col("how") == "often")).select(F.explode(_wildcards(F.col("t"))).alias("w")).distinct())
    near = counts.where(~recurs & long).select("t", F.explode(_wildcards(F.col("t"))).alias("w")).join(small(often), "w", "left_semi").select("t", F.lit("near").alias("how")).distinct()
    every = cut(known.union(near))
    return lines.join(small(every), "t").groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "how")).alias("marks"))


class Furniture:
    def __init__(self, model: Perceptron) -> None:
        self.model = model
        self.decided: dict[tuple, bool] = {}

    @staticmethod
    def features(lines: list[str], marks: dict[int, str]) -> Iterator[tuple[int, tuple]]:
        """(line, features) of the lines that are not blank."""
        number = [bool(_NUMBER.fullmatch(x.strip())) for x in lines]
        for k, place in enumerate(places(lines)):
            if place != "blank":
                before, after = number[k - 1] if k and lines[k - 1] else None, number[k + 1] if k + 1 < len(lines) and lines[k + 1] else None
                yield k, line_features(lines[k], place, number[k], before, after, marks.get(k, "no"))

    def of_page(self, lines: list[str], marks: dict[int, str]) -> set[int]:
        gone = set()
        for k, f in self.features(lines, marks):
            got = self.decided.get(f)
            if got is None:
                got = self.decided[f] = self.model.best(line_options(f)) == 1
            if got:
                gone.add(k)
        return gone


def marks_of(marks: list[dict] | None) -> dict[int, str]:
    return {m["at"]: m["how"] for m in marks or ()}


def line_seeds(lines: list[str], marks: dict[int, str]) -> Iterator[tuple[tuple, int]]:
    """(features, 1 for furniture or 0 for text) of the lines of a page for which place and recurrence agree."""
    for k, f in Furniture.features(lines, marks):
        place, number, seen, heading = f[0], f[1], f[4], f[6]
        if number and place in ("first", "last") or not heading and (seen in ("often", "near") or seen == "some" and place != "mid"):
            yield f, 1
        elif seen == "no" and not number:
            yield f, 0
        elif number and any(marks.get(j, "no") != "no" for j in (k - 1, k + 1)):
            yield f, 1


def train_furniture(pages: DataFrame) -> Furniture:
    """Fitted on the lines of all pages: few different ones occur, so they are counted first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                counts.update(line_seeds(text.split("\n"), marks_of(marks)))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(f) for f, _ in counts], pa.string()), pa.array([right for _, right in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["f", "right", "n"])

    rows = pages.select("text", "marks").mapInArrow(run, "f string, right int, n long").groupBy("f", "right").agg(F.sum("n").alias("n")).orderBy("f", "right").collect()
    return Furniture(Perceptron.train(in_proportion([((line_options(tuple(json.loads(r["f"]))), r["right"]), r["n"]) for r in rows], 4 * SEEDS)))


END = "struct<line_no:int,mark:string,word:string,first:string,dense:boolean>"


def words_of(lines: list[str], furniture: set[int]) -> Iterator[tuple[int, str, str, str | None, bool]]:
    """(line, word, mark, first part, dense): the words of the running text. ``mark`` is empty for whole words; a word
    divided at a line's end comes with its mark, its first part and the line it begins on. ``dense``: the line is full
    of hyphens, as transliterations are."""
    run = [k for k in range(len(lines)) if k not in furniture]
    carried: set[int] = set()
    for at, k in enumerate(run):
        tokens = _TOKEN.findall(lines[k])
        dense = sum("-" in t.strip(_MARKS) for t in tokens) * 3 >= len(tokens)
        if at in carried and tokens:
            tokens = tokens[1:]
        end = lines[k].rstrip()
        if tokens and end[-1:] in _MARKS and end[-1:] and at + 1 < len(run) and len(tokens[-1].strip(_MARKS)) and end.endswith(tokens[-1]):
            follow = _TOKEN.findall(lines[run[at + 1]])
            if follow and lines[run[at + 1]].strip():
                carried.add(at + 1)
                head = tokens.pop().rstrip(_MARKS)
                yield k, follow[0], end[-1], head, dense
        for t in tokens:
            if t := t.rstrip(_SURE):
                yield k, t, "", None, dense


def read_pages(pages: DataFrame) -> DataFrame:
    """(row_id, gone, words, at, ends): of each page its furniture lines, the words of its running text with their lines,
    and the words divided at line ends. Each page is decided once."""
    shared = pages.sparkSession.sparkContext.broadcast(train_furniture(pages))
    schema = f"row_id long, gone array<int>, words array<string>, at array<int>, ends array<{END}>"
    end = pa.struct([("line_no", pa.int32()), ("mark", pa.string()), ("word", pa.string()), ("first", pa.string()), ("dense", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                out: tuple[list, ...] = ([], [], [], [])
                for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                    lines = text.split("\n")
                    gone = f.of_page(lines, marks_of(marks))
                    words, at, ends = [], [], []
                    for k, w, m, h, d in words_of(lines, gone):
                        if m:
                            ends.append({"line_no": k + 1, "mark": m, "word": w, "first": h, "dense": d})
                        else:
                            words.append(w)
                            at.append(k + 1)
                    for x, y in zip(out, ([k + 1 for k in sorted(gone)], words, at, ends), strict=True):
                        x.append(y)
                kinds = (pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(end))
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["row_id", "gone", "words", "at", "ends"])

    return pages.select("row_id", "text", "marks").mapInArrow(run, schema)


# --- the character editor ---


def one_place(word: str) -> Iterator[tuple[tuple[str, str], str]]:
    """((before, behind), what stands between): a word with a place of up to two characters left open."""
    for i in range(len(word) + 1):
        for j in range(i, min(i + 2, len(word)) + 1):
            yield (word[:i], word[j:]), word[i:j]


def plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def shows(n: int | Column, m: int | Column) -> bool | Column:
    """Whether a word that occurs ``n`` times may be a misreading of one that occurs ``m`` times. A word of few occurrences
    may be so by chance; in a large collection a misreading is no rare word, but keeps its share of the right one."""
    return (m >= RATIO * n) & ((n < KNOWN) | (m >= FAR * n))


def spelling(read: str, written: str) -> bool:
    """Whether two strings are the same letters but for marks and case."""
    return plain(read).lower() == plain(written).lower()


def accepted(words_of: dict[tuple[str, str], int]) -> list[tuple[str, str]]:
    """The operations among (read, written), given the number of words that show each."""
    words_of = {o: k for o, k in words_of.items() if not spelling(*o)}
    least = max(TIMES, SHARE * max(words_of.values(), default=0))
    return sorted(o for o, k in words_of.items() if k >= least and k >= ONE_WAY * words_of.get((o[1], o[0]), 0))


def learn_operations(rare: dict[str, int], frequent: dict[str, int]) -> list[tuple[str, str]]:
    """(read, written) of the misreadings that rare words show beside frequent ones (both with their counts) that differ in
    one place. Differences in marks and case are spellings. The plain form of ``operations_of``."""
    at: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for w in frequent:
        for key, between in one_place(w):
            at.setdefault(key, []).append((between, w))
    shown: dict[tuple[str, str], set[str]] = {}
    for w, n in rare.items():
        for key, read in one_place(w):
            for written, other in at.get(key, ()):
                # the shortest place only: what both have in common is no part of it
                if shows(n, frequent[other]) and read != written and len(read) + len(written) <= 3 and (not read or not written or read[0] != written[0] and read[-1] != written[-1]):
                    shown.setdefault((read, written), set()).add(w)
    return accepted({o: len(x) for o, x in shown.items()})


def operations_of(words: DataFrame) -> list[tuple[str, str]]:
    """The operations that all of the given words (word, n) show: words that differ in one place meet in a join. To the
    driver come only the operations that ``TIMES`` words show, and their reverses, with their numbers of words."""
    i, size, length = F.col("i"), F.col("size"), F.length("word")
    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), length)).alias("i")).select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("size")).where(i + size <= length)
    places = places.select("word", "n", F.xxhash64(F.substring("word", F.lit(1), i), i, F.substring("word", i + size + 1, length)).alias("key"), F.substring("word", i + 1, size).alias("between"))
    read = places.select("key", F.col("between").alias("read"), "word", "n")
    right = places.where(F.col("n") >= 3 * KNOWN).select("key", F.col("between").alias("written"), F.col("n").alias("m"))
    apart = F.expr("read <> written and length(read) + length(written) <= 3 and (read = '' or written = '' or left(read, 1) <> left(written, 1) and right(read, 1) <> right(written, 1))")
    shown = read.join(right, "key").where(shows(F.col("n"), F.col("m")) & apart)
    counts = cut(shown.groupBy("read", "written").agg(F.count_distinct("word").alias("k")))
    often = counts.where(F.col("k") >= TIMES).select("read", "written")
    back = often.select(F.col("written").alias("read"), F.col("read").alias("written"))
    return accepted({(r["read"], r["written"]): r["k"] for r in counts.join(often.union(back).distinct(), ["read", "written"]).collect()})


def sites(word: str, strings: list[str]) -> Iterator[tuple[int, int]]:
    """(position, number) of all places of the given strings; the empty one stands everywhere."""
    for n, s in enumerate(strings):
        at = word.find(s)
        while at >= 0:
            yield at, n
            at = word.find(s, at + 1)


def put(word: str, at: int, old: str, new: str) -> str:
    return word[:at] + new + word[at + len(old) :]


def level(x: float) -> int:
    return int(log2(x)) if x > 0 else -1


class Editor:
    """Scores the operations on a word's characters."""

    def __init__(self, operations: list[tuple[str, str]], model: Perceptron) -> None:
        self.operations, self.model = operations, model
        self.read = [r for r, _ in operations]

    def character(self, word: str, at: int, n: int, known: str) -> list[str]:
        read, written = self.operations[n]
        before, after = word[at - 1] if at else "^", word[at + len(read)] if at + len(read) < len(word) else "$"
        op = f"{read}>{written}"
        kind = lambda c: "a" if c.isalpha() else "0" if c.isdigit() else c
        return [op, f"{op},{known}", f"{op},{before}_", f"{op},_{after}", f"{op},{kind(before)}_{kind(after)}"]

    def keep(self, word: str, n: int) -> tuple[str, list[str]]:
        return "keep", ["bias", f"n={min(level(n), 6)}", f"size={min(len(word), 5)}"]

    def unknown(self, word: str, n: int, at: int, op: int) -> tuple[str, list[str]]:
        return "edit", ["bias", "unknown", f"n={min(level(n), 6)},unknown", f"size={min(len(word), 5)}", *self.character(word, at, op, "unknown")]

    def options(self, word: str, n: int, hits: list[dict]) -> tuple[list[tuple[str, list[str]]], list[tuple[str, int]]]:
        """Keep; each way to a known word; each single operation that leads to none. With each what comes out and the
        first character that was misread."""
        size = f"size={min(len(word), 5)}"
        options, out = [self.keep(word, n)], [(word, len(word))]
        ways = set()
        for h in hits:
            times = max(-1, min(8, level(h["m"] / max(n, 1))))
            known = f"known={times}"
            f = ["bias", known, f"n={min(level(n), 6)},{known}", size, f"steps={1 + (h['op2'] >= 0)}", *(f"known>{k}" for k in range(times)), *self.character(word, h["at"], h["op"], "known")]
            at = h["at"]
            if h["op2"] >= 0:
                f += self.character(put(word, at, *self.operations[h["op"]]), h["at2"], h["op2"], "known")
                at = min(at, h["at2"])
            else:
                ways.add((h["at"], h["op"]))
            options.append(("edit", f))
            out.append((h["right"], at))
        for at, op in sites(word, self.read):
            if (at, op) not in ways:
                options.append(self.unknown(word, n, at, op))
                out.append((put(word, at, *self.operations[op]), at))
        return options, out

    def repair(self, word: str, n: int, hits: list[dict]) -> tuple[str, int] | None:
        """(repaired word, first misread character), or nothing to repair. A word that becomes no known one by an
        operation may have others to be repaired."""
        if len(word) > LONG:
            return self.repair_long(word)
        options, out = self.options(word, n, hits)
        k = self.model.best(options) if len(options) > 1 else 0
        if not k:
            return None
        right, at = out[k]
        if k > len(hits):
            for _ in range(len(word)):
                options, out = self.options(right, 0, [])
                k = self.model.best(options) if len(options) > 1 else 0
                if not k or len(out[k][0]) > 2 * len(word):
                    break
                right, at = out[k][0], min(at, out[k][1])
        return right, at

    def seeds(self, batch: pa.RecordBatch) -> Iterator[tuple[list[tuple[str, list[str]]], int]]:
        """Examples from words (word, n, hits) that are surely misread, or as usual."""
        for word, n, hits, misread in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "hits", "misread")), strict=True):
            if misread:
                k = max(range(len(hits)), key=lambda i: (hits[i]["m"], -i))
                yield self.options(word, n, hits)[0], k + 1
                if hits[k]["op2"] < 0:  # as if the right word were not known
                    options, out = self.options(word, 0, [])
                    yield options, out.index((hits[k]["right"], hits[k]["at"]))
            else:
                for m, known in ((n, hits), (0, [])):
                    options = self.options(word, m, known)[0]
                    if len(options) > 1:
                        yield options, 0

    def repair_long(self, word: str) -> tuple[str, int] | None:
        """The same of a long word, in time that grows with its length: each place is decided for itself."""
        at_place: dict[int, list[int]] = {}
        for at, op in sites(word, self.read):
            at_place.setdefault(at, []).append(op)
        out, done, first = [], 0, -1
        for at in sorted(at_place):
            if at < done:
                continue
            begin = max(0, at - AROUND)
            near = word[begin : at + AROUND]
            k = self.model.best([self.keep(near, 0), *(self.unknown(near, 0, at - begin, op) for op in at_place[at])])
            if k:
                read, written = self.operations[at_place[at][k - 1]]
                out += [word[done:at], written]
                done, first = at + len(read), at if first < 0 else first
        return ("".join([*out, word[done:]]), first) if out else None


HIT = "struct<m:bigint,right:string,at:int,op:int,at2:int,op2:int>"


def known_repairs(every: DataFrame, vocabulary: DataFrame, operations: list[tuple[str, str]]) -> DataFrame:
    """``every`` (word, n) with ``hits``: the known words that one or two operations lead to. Words as read and known words
    misread once meet in a join, so nothing is tried out in vain and nothing is left out."""
    read, written = [r for r, _ in operations], [w for _, w in operations]

    def steps(find: list[str], forward: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w, v, a, o = [], [], [], []
                for word in batch.column(0).to_pylist():
                    for at, n in sites(word, find) if len(word) <= LONG else ():
                        w.append(word)
                        v.append(put(word, at, read[n], written[n]) if forward else put(word, at, written[n], read[n]))
                        a.append(at)
                        o.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(v, pa.string()), pa.array(a, pa.int32()), pa.array(o, pa.int32())], names=["word", "v", "at", "op"])

        return run

    frequent = vocabulary.where(F.col("n") >= KNOWN)
    misread = frequent.select("word").mapInArrow(steps(written, False), "word string, v string, at int, op int").join(frequent, "word").select("v", F.col("word").alias("right"), F.col("n").alias("m"), "at", "op")
    misread = cut(misread)
    none = F.lit(-1)
    hit = lambda *c: F.struct("m", "right", *(x.cast("int").alias(n) for x, n in zip(c, ("at", "op", "at2", "op2"), strict=True))).alias("h")
    once = every.select(F.col("word").alias("v")).join(misread, "v").select(F.col("v").alias("word"), hit(F.col("at"), F.col("op"), none, none))
    first = every.select("word").mapInArrow(steps(read, True), "word string, v string, at int, op int")
    second = misread.withColumnsRenamed({"at": "at2", "op": "op2"})
    twice = first.join(second, "v").where("word <> right").select("word", hit(F.col("at"), F.col("op"), F.col("at2"), F.col("op2")))
    hits = once.where("v <> h.right" if "v" in once.columns else "word <> h.right").union(twice).groupBy("word").agg(F.array_sort(F.collect_set("h")).alias("hits"))
    return every.join(hits, "word", "left").select("word", "n", F.coalesce("hits", F.array().cast(f"array<{HIT}>")).alias("hits"))


def corrections(vocabulary: DataFrame, extra: DataFrame) -> DataFrame:
    """(word, right, at): repaired words with the position of the first misread character.

    ``vocabulary`` has (word, n) of all words, ``extra`` further words (of divided ones). Each distinct word is
    decided once.
    """
    every = vocabulary.select("word", "n").union(extra.select("word", F.lit(0).cast("long"))).groupBy("word").agg(F.sum("n").alias("n")).where(r"word rlike '\\p{L}'")
    every = cut(every)
    whole = vocabulary.where(F.length("word") <= LONG).where(r"word rlike '\\p{L}' and word not rlike '[-\\u00ad\\u00ac]$'").select("word", "n")
    editor = Editor(operations_of(whole), Perceptron())
    hit = cut(known_repairs(every, vocabulary, editor.operations))
    best, n = F.array_max("hits")["m"], F.greatest("n", F.lit(1))
    misread, usual = F.coalesce(shows(n, best), F.lit(False)), (F.col("n") >= KNOWN) & F.coalesce(best < RATIO * n, F.lit(True))
    seeds = hit.where(F.length("word") <= LONG).select("word", "n", "hits", misread.alias("misread")).where(F.col("misread") | usual)
    editor.model = fit(seeds, "word", editor.seeds, epochs=8)
    shared = hit.sparkSession.sparkContext.broadcast(editor)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, v, a = [], [], []
            for word, n, hits in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "hits")), strict=True):
                if got := shared.value.repair(word, n, hits):
                    w.append(word)
                    v.append(got[0])
                    a.append(got[1])
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(v, pa.string()), pa.array(a, pa.int32())], names=["word", "right", "at"])

    return hit.mapInArrow(decide, "word string, right string, at int")


def train_joins(ends: DataFrame) -> Perceptron:
    """Join, or join with the hyphen: seeds are all line ends where only one of the two words is known. They differ in few
    features, by which they are counted first."""
    seeds = ends.where(f"(nj >= {KNOWN} and nh = 0) or (nh >= {KNOWN} and nj = 0)")
    kinds = ["mark", "inner", "dense", "nj", "nh"]
    rows = seeds.select("mark", F.expr("if(contains(first, '-') or contains(word, '-'), '-', '')").alias("inner"), "dense", F.expr("cast(nj > 0 as int)").alias("nj"), F.expr("cast(nh > 0 as int)").alias("nh")).groupBy(*kinds).agg(F.count("*").alias("n")).orderBy(*kinds).collect()
    return Perceptron.train(in_proportion([((join_options(r["mark"], r["inner"], "", r["dense"], r["nj"], r["nh"]), r["nh"]), r["n"]) for r in rows], SEEDS))


def join_options(mark: str, first: str, word: str, dense: bool, joined: int, hyphened: int) -> list[tuple[str, list[str]]]:
    more = "joined" if joined > hyphened else "hyphened" if hyphened > joined else "none" if not joined else "same"
    inner = "-" in first or "-" in word
    f = ["bias", f"more={more}", f"mark={mark == '-'}", f"mark={mark == '-'},more={more}", f"dense={dense}", f"inner={inner}", f"dense={dense},more={more}", f"dense={dense},inner={inner}", f"known={joined > 0}{hyphened > 0}"]
    return [("join", f), ("hyphen", f)]


def defects(df: DataFrame, id_column: str = "row_id", text_column: str = "page_text") -> DataFrame:
    """(row_id, line_no, defect, word, first, right): all defects, with what repairs them.

    ``furniture``: the line goes. ``hyphen``: ``first`` and the next line's ``word`` are one word. ``glyph``: ``word``
    (of which ``first`` stands on the line before, if any) should be ``right``. Lines count from 1; null and empty pages
    have none; repeated rows are repeated.
    """
    pages = spread(_pages(df, id_column, text_column)).select("*", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))
    marked = cut(pages.join(recurring_lines(pages), ["k1", "k2"], "left").select("row_id", "text", "marks"))
    read = cut(read_pages(marked))
    none = F.lit(None).cast("string")
    gone = read.select("row_id", F.explode("gone").alias("line_no")).select("row_id", F.col("line_no").cast("long").alias("line_no"), F.lit("furniture").alias("defect"), none.alias("word"), none.alias("first"), none.alias("right"))
    vocabulary = cut(read.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    n = vocabulary.select("word", "n")
    ends = read.select("row_id", F.inline("ends")).withColumn("line_no", F.col("line_no").cast("long")).withColumn("j", F.concat("first", "word")).withColumn("h", F.concat("first", F.lit("-"), "word"))
    ends = ends.join(n.select(F.col("word").alias("j"), F.col("n").alias("nj")), "j", "left").join(n.select(F.col("word").alias("h"), F.col("n").alias("nh")), "h", "left").na.fill(0, ["nj", "nh"])
    ends = cut(ends)
    joins = pages.sparkSession.sparkContext.broadcast(train_joins(ends))
    names = ["row_id", "line_no", "mark", "word", "first", "dense", "nj", "nh"]

    def join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in names}
            hyphen = [bool(m in "­¬" or not joins.value.best(join_options(m, *x))) for m, *x in zip(*(cols[c] for c in ("mark", "first", "word", "dense", "nj", "nh")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_id", "line_no", "word", "first")), pa.array(hyphen, pa.bool_())], names=["row_id", "line_no", "word", "first", "join"])

    divided = cut(ends.select(*names).mapInArrow(join_lines, "row_id long, line_no long, word string, first string, join boolean"))
    hyphens = divided.where("join").select("row_id", "line_no", F.lit("hyphen").alias("defect"), "word", "first", none.alias("right"))
    whole = F.when(F.col("join"), F.concat("first", "word")).otherwise(F.concat("first", F.lit("-"), "word"))
    split = divided.select("row_id", "line_no", whole.alias("word"), "first")
    fixed = cut(corrections(vocabulary, split.select("word").distinct()))
    words = read.select("row_id", F.explode(F.arrays_zip(F.col("at").alias("line_no"), F.col("words").alias("word"))).alias("t")).select("row_id", F.col("t.line_no").cast("long").alias("line_no"), "t.word", none.alias("first"))
    glyphs = words.union(split.select("row_id", "line_no", "word", "first")).join(small(fixed), "word")
    moved = F.when(F.col("at") >= F.length("first"), 1).otherwise(0)
    glyphs = glyphs.select("row_id", (F.col("line_no") + moved).alias("line_no"), F.lit("glyph").alias("defect"), "word", "first", "right")
    return gone.union(hyphens).union(glyphs)


def paragraphs(df: DataFrame, id_column: str = "row_id", text_column: str = "page_text") -> DataFrame:
    """(row_id, paragraph_no, text): the repaired running text of each page; blank lines part paragraphs.

    Transliterations keep the hyphens between signs. Null, empty and furniture-only pages have no paragraph.
    """
    found = defects(df, id_column, text_column).groupBy("row_id").agg(F.collect_set(F.struct("line_no", "defect", "word", "first", "right")).alias("found"))
    pages = _pages(df, id_column, text_column).dropDuplicates(["row_id"]).join(found, "row_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, texts = [], [], []
            for i, text, found in zip(batch.column("row_id").to_pylist(), batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                for k, p in enumerate(rebuild(text, found or [])):
                    ids.append(i)
                    numbers.append(k + 1)
                    texts.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["row_id", "paragraph_no", "text"])

    return pages.mapInArrow(run, "row_id long, paragraph_no int, text string")


def rebuild(text: str, found: list[dict]) -> list[str]:
    """The paragraphs of a page from its lines and their defects."""
    lines = text.split("\n")
    gone = {d["line_no"] - 1 for d in found if d["defect"] == "furniture"}
    joined = {d["line_no"] - 1 for d in found if d["defect"] == "hyphen"}
    right = {d["word"]: d["right"] for d in found if d["defect"] == "glyph"}
    out, now = [], ""
    divided = False
    for k, line in enumerate(lines):
        if k in gone:
            continue
        s = line.strip()
        if not s:
            if now and not divided:
                out.append(now)
                now = ""
            continue
        if divided:
            now += s
        else:
            now = f"{now} {s}" if now else s
        divided = s[-1] in _MARKS
        if divided and (k in joined or s[-1] != "-"):
            now = now.rstrip(_MARKS)
    if now:
        out.append(now)

    def repaired(m: re.Match) -> str:
        word = m.group().rstrip(_SURE)
        return right.get(word, word) + m.group()[len(word) :]

    return [_TOKEN.sub(repaired, p) for p in out]
