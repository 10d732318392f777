"""Problem 2: source text that nobody on the project wrote, by families of masked token shingles.

Every file becomes a set of five-token shingles in which identifiers, numbers and strings are masked. Files with the same set
form one class; MinHash bands find classes that may resemble each other and the exact similarity (0.8 or more) verifies them.
Connected classes are a family, and the family decides: one that holds a released library file is vendored as far as its
members hold the release's own shingles, one whose members are lists of literals is a blob, one whose members vote that a tool
wrote or minified them is generated or minified. A file that resembles no other is a family of one. What masking hides from
the families (layout, opening comments) is looked up in the members that their family does not decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.components import connected_components
from marlstone.session import cut

WIDTH, BANDS, ROWS, SIMILARITY = 5, 20, 5, 0.8
#: Tokens per distinct masked shingle from which text is repetitive beyond what people write; for lists of literals less.
REPETITION, LITERAL_REPETITION = 5.0, 3.5
#: Share of strings and numbers among the words of repetitive text; lists of declarations that people write have fewer.
LITERAL_TOKENS = 0.15
#: Tokens of the stretches over which repetition is counted, so that it does not grow with the length of a file.
STRETCH = 700
#: Characters and tokens to the line on average from which code is minified.
DENSE_LINE, DENSE_TOKENS = 200, 40
#: Share of the characters that lie in strings and numbers, and the length of one literal, that make a blob.
LITERAL_SHARE, LONG_LITERAL = 0.7, 200
#: Share of its members that must vote for a family's kind; less for a family that lies in one repository, where likeness
#: itself points to a tool, from FAMILY_SIZE members on.
FAMILY_SHARE, ONE_REPO_SHARE, FAMILY_SIZE = 0.6, 0.3, 3
#: Share of a release's own token shingles that a copy of it holds.
COPY_SHARE = 0.6
#: Classes of a bucket, and shingles in them, that meet in one block; columns of shingles counted at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 4_000_000, 4096
#: Classes of a bucket up to which plain sets are compared.
SMALL = 12

_TOKEN = re.compile(r"/\*(?:[^*]|\*(?!/))*\*/|//[^\n]*|\"\"\"(?:[^\"]|\"(?!\"\"))*\"\"\"|'''(?:[^']|'(?!''))*'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|0[xX][0-9a-fA-F]+|\d[\w.]*|[^\W\d]\w*|[^\s\w]", re.DOTALL)
_HASH_COMMENT = re.compile(r"(?m)(?:^|(?<=\s))#[^\n]*")
# Words of the supported languages that stay as they are under masking.
_WORDS = frozenset("abstract address as assembly async await bool break bytes catch class const constant constructor continue contract def del delete do elif else emit enum error event except export extends false finally for from function global if import in indexed interface internal is lambda let library mapping memory modifier new not null or and override pass payable pragma private public pure raise receive require return returns revert self static storage string struct super switch this throw true try typeof uint256 unchecked using var view virtual void while with yield None True False".split())
_LITERAL_WORDS = frozenset(["true", "false", "null", "None", "True", "False"])
_TOOL = r"(?:tool|script|compiler|generator|template|build step|pipeline|protoc|make|abi|schema|proto|idl|json|wasm|\w*gen\b|\w+ v?\d+\.\d+)"
# How tools say in an opening comment that they wrote the file.
_NOTICE = re.compile(
    r"@generated\b|\b(?:auto|machine)(?:matically)?[- ]?(?:generated|written|created|made|produced|built)\b"
    r"|^(?:this|the) (?:file|code|module|source|contract|script|document) (?:is|was|has been) (?:generated|produced|written|created|emitted|built|exported|compiled)\b"
    rf"|^(?:code |source |file )?(?:generated|produced|emitted|compiled|exported|bundled|transpiled) (?:by|from|with|using|via)\b|^(?:written|created|built|made) (?:by|from|with) (?=.*{_TOOL})"
    r"|\bdo(?:n'?t| not) (?:edit|modify|change|touch|alter)\b(?: (?:this file|the file|by hand|manually|directly|it)|[^\w]*$|.*\b(?:regenerat|generat))|\bnot (?:be )?(?:edited|modified|changed) (?:by hand|manually)\b"
    r"|\b(?:manual )?(?:changes|edits|modifications) (?:will|would|are) (?:be )?(?:lost|overwritten)\b|\bchange the (?:template|generator|schema|source) instead\b|\bregenerate (?:it |this )?(?:with|using|by|via)\b"
    r"|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bnicht (?:von hand |manuell )?(?:bearbeiten|ändern|editieren)\b|\bg[ée]n[ée]r[ée]e? automatiquement\b|\bne pas (?:modifier|éditer)\b|\bgenerado autom[aá]ticamente\b|\bno (?:editar|modificar)\b"
    r"|\bgerado automaticamente\b|\bgenerato automaticamente\b|автоматически (?:сгенерирован|создан)|сгенерирован(?:о|ный)? автоматически|не редактировать|自动生成|自動生成|請勿(?:修改|編輯)|请勿(?:修改|编辑|手动)|勿手动|編集しないで|자동 ?생성|수정하지 마",
    re.IGNORECASE,
)
_OPENING = re.compile(r"\s*(?:(?:#!.*\n|\"use strict\";?|'use strict';?)\s*)?(/\*(?:[^*]|\*(?!/))*\*/|(?:[ \t]*//[^\n]*(?:\n|\Z)\s*)+|(?:[ \t]*#[^\n]*(?:\n|\Z)\s*)+|<!--.*?-->|\"\"\"(?:[^\"]|\"(?!\"\"))*\"\"\")", re.DOTALL)
_FILE_MARK = re.compile(r"(?m)^[ \t]*(?:///?|/\*+|\*|#+)[ \t=*#-]*(?:File|Original file|Source|Dependency|Flattened)[: ]+\S+")
_CODE = frozenset(["sol", "js", "py"])
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_POW = np.cumprod(np.full(WIDTH, 0x9E3779B97F4A7C15, dtype=np.uint64))
_NAMES, _STRINGS, _NUMBERS, _KEPT, _VALUES, _OTHER = range(6)


class _Words(dict):
    """Numbers of tokens, given at first sight; of each: hash, hash under its mask, class of token, length."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, int, int, int]] = []  # of the numbers that the table does not hold yet
        self.known, self.table = 0, np.zeros((4, 1024), np.uint64)

    def __missing__(self, t: str) -> int:
        c = t[0]
        if c in "\"'`":
            kind, mask = _STRINGS, "S"
        elif c.isdigit():
            kind, mask = _NUMBERS, "N"
        elif t in _WORDS:
            kind, mask = (_VALUES if t in _LITERAL_WORDS else _KEPT), t
        elif c.isalpha() or c == "_":
            kind, mask = _NAMES, "I"
        else:
            kind, mask = _OTHER, t
        self.rows.append((crc32(t.encode("utf-8", "surrogatepass")), crc32(mask.encode("utf-8", "surrogatepass")), kind, len(t)))
        self[t] = n = self.known + len(self.rows) - 1
        return n

    def look_up(self, tokens: list[str]) -> np.ndarray:
        """One column for each token, in the order of the rows."""
        if self.known > 500_000:  # only a store of what can be worked out again
            self.clear()
            self.known = 0
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.rows:
            end = self.known + len(self.rows)
            while end > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
            self.table[:, self.known : end] = np.array(self.rows, np.uint64).T
            self.known, self.rows = end, []
        return self.table[:, at]


_words = _Words()


def _tokens(text: str, language: str) -> np.ndarray:
    """Columns of the tokens without comments: hash, hash under the mask, class, length."""
    if language == "py":
        text = _HASH_COMMENT.sub("", text)
    return _words.look_up([t for t in _TOKEN.findall(text) if t[0] != "/" or len(t) == 1])


def _runs(h: np.ndarray) -> np.ndarray:
    """Hashes (32 bits) of the runs of five tokens in their order; a shorter text is one run."""
    if not len(h):
        return np.zeros(0, np.uint32)
    if len(h) < WIDTH:
        total = np.array([(h * _POW[: len(h)]).sum(dtype=np.uint64)], dtype=np.uint64)
    else:
        n = len(h) - WIDTH + 1
        total = np.zeros(n, np.uint64)
        for k in range(WIDTH):
            total += h[k : k + n] * _POW[k]
    total ^= total >> np.uint64(31)
    return (total * _POW[1] >> np.uint64(32)).astype(np.uint32)


def _shingles(h: np.ndarray) -> np.ndarray:
    return np.unique(_runs(h))


def _repetition(runs: np.ndarray, n: int) -> float:
    """Tokens for each distinct shingle, counted over equal stretches of at most STRETCH tokens."""
    parts = max(1, -(-n // STRETCH))
    return n / max(1, sum(len(np.unique(x)) for x in np.array_split(runs, parts)))


def _bands(shingles: np.ndarray) -> list[int]:
    if not len(shingles):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        mixed = (shingles[at : at + 4096, None].astype(np.uint64) + np.uint64(1)) * _A + _B
        low = np.minimum(low, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    folded = np.zeros(BANDS, np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        folded = folded * np.uint64(0x9E3779B97F4A7C15) + row
    return (folded ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist()


def notice(text: str) -> bool:
    """Whether the opening comment says that a tool wrote the file."""
    m = _OPENING.match(text.removeprefix("\ufeff"))
    if not m:
        return False
    return any(_NOTICE.search(re.sub(r"^[\s/*#\"!<-]+|[\s*/>\"-]+$", "", line)) for line in m[1].splitlines())


def traits(text: str, language: str) -> tuple[np.ndarray, str, bool]:
    """Masked shingles, the kind that the file votes for ('' for none), and whether masking hides the ground of the vote."""
    _, hashes, kinds, lengths = _tokens(text, language)
    runs = _runs(hashes)
    shingles, n = np.unique(runs), len(kinds)
    ratio = _repetition(runs, n)
    literal = (kinds == _STRINGS) | (kinds == _NUMBERS)
    dense, literals, words = int(lengths.sum()), int(literal.sum()), int((kinds != _OTHER).sum())
    share, longest = int(lengths[literal].sum()) / max(1, dense), int(lengths[literal].max(initial=0))
    lines = text.strip().count("\n") + 1
    if notice(text):
        return shingles, "generated", True
    if language == "json":
        return shingles, "generated" if n >= 60 and (ratio >= LITERAL_REPETITION or longest >= LONG_LITERAL) else "", False
    if (share >= LITERAL_SHARE or literals >= 0.95 * max(1, words)) and (ratio >= LITERAL_REPETITION or longest >= LONG_LITERAL):
        return shingles, "table" if (kinds[:40] == _KEPT).any() else "blob", False
    if language in _CODE and dense >= 400 and lines * DENSE_LINE <= len(text) and lines * DENSE_TOKENS <= n:
        return shingles, "minified", True
    if len(_FILE_MARK.findall(text)) >= 2 or (language == "sol" and len(re.findall(r"(?m)^[ \t]*pragma solidity\b", text)) >= 2):
        return shingles, "generated", True
    return shingles, "generated" if ratio >= REPETITION and n >= 100 and literals >= LITERAL_TOKENS * words else "", False


_SCHEMA = "id bigint, released boolean, repo string, language string, class bigint, shingles binary, n int, bands array<bigint>, vote string, hidden boolean"
_ARROW = pa.schema([("id", pa.int64()), ("released", pa.bool_()), ("repo", pa.string()), ("language", pa.string()), ("class", pa.int64()), ("shingles", pa.binary()), ("n", pa.int32()), ("bands", pa.list_(pa.int64())), ("vote", pa.string()), ("hidden", pa.bool_())])


def _language(path: str | None) -> str:
    return (path or "").strip().rpartition(".")[2].lower()


def file_traits(rows: DataFrame) -> DataFrame:
    """For rows (id, released, repo, path, content): the columns of the schema above. ``class`` hashes the set of shingles,
    ``shingles`` holds the sorted set as bytes and ``n`` its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _ARROW]
            for key, released, repo, path, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                language = _language(path)
                shingles, vote, hidden = traits(text, language)
                wide = shingles.astype(np.uint64) + np.uint64(1)
                # the set itself, not its members alone, names the class
                name = (int(((wide * _A[0]) ^ (wide * _B[0] >> np.uint64(7))).sum(dtype=np.uint64)) * int(_A[1]) + len(shingles)) % 2**63 if len(shingles) else -1
                for column, value in zip(out, (key, released, repo, language, name, shingles.tobytes(), len(shingles), _bands(shingles), vote, hidden), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ARROW, strict=True)], schema=_ARROW)

    return rows.mapInArrow(run, _SCHEMA)


def _spanning(names: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest over all pairs of the sets that are similar enough; every pair is compared. Each family is
    a star around its smallest name."""
    if len(sets) <= SMALL:  # as most buckets are: plain sets, and no look at pairs whose sizes differ too much
        plain = [frozenset(x.tolist()) for x in sets]
        root = list(range(len(sets)))
        for j in range(1, len(sets)):
            for k in range(j):
                least, most = sorted((len(plain[j]), len(plain[k])))
                if root[j] != root[k] and least >= SIMILARITY * most:
                    both = len(plain[j] & plain[k])
                    if both >= SIMILARITY * (least + most - both):
                        old, new = root[j], root[k]
                        root = [new if r == old else r for r in root]
        for r in set(root):
            family = sorted(names[k] for k in range(len(sets)) if root[k] == r)
            yield from ((family[0], other) for other in family[1:])
        return
    sizes = np.array([len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times > 1  # what a single set holds adds to no pair
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - at)), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    fresh = np.ones(len(sets), bool)
    for first in np.argsort(np.array(names), kind="stable").tolist():
        if not fresh[first]:
            continue
        fresh[first], todo = False, [first]
        while todo:
            k = todo.pop()
            near = np.flatnonzero(fresh & (common[k] / (sizes + sizes[k] - common[k].astype(np.float64)) >= SIMILARITY))
            fresh[near] = False
            for j in near.tolist():
                todo.append(j)
                yield names[first], names[j]


def class_links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between classes that share a band and whose families a chain of verified pairs joins, a < b.

    In every bucket all pairs are compared, exactly. A bucket of more than ``block`` classes, or of more shingles than a
    block may hold, is split into blocks, and every two blocks meet in a group of their own, so memory is bounded and no pair
    is left out. Buckets with the same classes as another are compared once. Of a group only a star around the smallest class
    of each of its families is kept. ``classes`` has class, shingles, n and bands.
    """
    keys = ["band", "value"]
    members = classes.select("class", "n", F.posexplode("bands").alias(*keys))
    mark = F.xxhash64("class")
    many = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("n").cast("long")).alias("total"), F.bit_xor(mark).alias("x"), F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("y")).filter("size > 1")
    many = many.groupBy("size", "x", "y").agg(F.min(F.struct(*keys, "total")).alias("b")).select("b.band", "b.value", F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("b.total") / BLOCK_SHINGLES)).alias("blocks"))
    rows = members.drop("n").join(many.hint("merge"), keys).withColumn("own", F.pmod(F.xxhash64("class", "band"), F.col("blocks")))
    # of several blocks every two meet, which compares the pairs inside of each as well
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.expr("filter(sequence(0L, blocks - 1L), x -> x <> own)"))
    placed = rows.withColumn("other", F.explode(other)).select(*keys, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "class")
    group = [*keys, "low", "high"]
    full = placed.join(classes.select("class", "shingles").hint("merge"), "class").select(*group, "class", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets = None, [], []

        def close() -> pa.RecordBatch:
            links = list(_spanning(names, sets)) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *key, name, data in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if key != now:
                    if len(names) > 1:
                        yield close()
                    now, names, sets = key, [], []
                names.append(name)
                sets.append(np.frombuffer(data, np.uint32))
        yield close()

    return full.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a bigint, b bigint").distinct()


def _texts(files: DataFrame, key: str, repo: str, released: bool) -> DataFrame:
    return files.select(F.col(key).cast("long").alias("id"), F.lit(released).alias("released"), F.col(repo).alias("repo"), "path", "content").filter("id is not null and content is not null")


def file_families(files: DataFrame, releases: DataFrame) -> DataFrame:
    """For every file with a text: file_id, repo, language, family (smallest class of its family), members, repos, released
    (whether a library release is in the family), vote and hidden (of the file), family_kind (what the family decides, '' if
    nothing), and release_id with ``held`` if the file is a verified copy of a release in its family.

    Files without an id or text give no rows; repeated rows count once. Empty texts are a class of their own without bands.
    """
    ours, theirs = _texts(files, "file_id", "repo", False), _texts(releases, "release_id", "package", True)
    rows = cut(file_traits(ours.unionByName(theirs)))
    classes = cut(rows.filter("class >= 0").groupBy("class").agg(F.first("shingles").alias("shingles"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    families = connected_components(None, cut(class_links(classes))).select(F.col("id").alias("class"), F.col("component").alias("family"))
    placed = rows.select("id", "released", "repo", "language", "class", "vote", "hidden").dropDuplicates(["id", "released"]).join(families.hint("merge"), "class", "left").withColumn("family", F.coalesce("family", "class"))
    placed = cut(placed)
    votes = placed.filter("not released").groupBy("family", "vote").agg(F.count(F.lit(1)).alias("n"), F.min("repo").alias("r0"), F.max("repo").alias("r1"), F.count_if(F.col("repo").isNull()).alias("none"))
    # first by votes, then by name, so that a tie has one result
    best = F.max(F.when(F.col("vote") != "", F.struct("n", "vote")))
    one_repo = (F.min("r0") == F.max("r1")) & (F.sum("none") == 0)
    total, shown = F.sum("n"), F.coalesce(F.sum(F.when(F.col("vote") != "", F.col("n"))), F.lit(0))
    share = F.when(one_repo & (total >= FAMILY_SIZE), ONE_REPO_SHARE).otherwise(FAMILY_SHARE)
    decided = F.when((F.first("family") >= 0) & (shown >= share * total), best["vote"]).otherwise("")
    kinds = votes.groupBy("family").agg(total.alias("members"), F.coalesce(one_repo, F.lit(False)).alias("one_repo"), F.coalesce(decided, F.lit("")).alias("family_kind"))
    anchors = placed.filter("released").groupBy("family").agg(F.collect_set("id").alias("releases"))
    ready = placed.filter("not released").join(kinds.hint("merge"), "family").join(anchors.hint("merge"), "family", "left")
    copies = _verified_copies(ready.filter("releases is not null").select("id", F.explode("releases").alias("release_id")), ours, theirs)
    return ready.join(copies.hint("merge"), "id", "left").select(
        F.col("id").alias("file_id"), "repo", "language", "family", "members", "one_repo", F.col("releases").isNotNull().alias("released"), "vote", "hidden", "family_kind", "release_id", "held"
    )


def _verified_copies(pairs: DataFrame, files: DataFrame, releases: DataFrame) -> DataFrame:
    """``id, release_id, held``: of each file the release of which it holds the largest share of unmasked shingles, if that
    share reaches COPY_SHARE; the smaller id of equal ones. Only the texts of families that hold a release are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for key, release, path, mine, other_path, text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                own, other = (_shingles(_tokens(t, _language(p))[0]) for p, t in ((path, mine), (other_path, text)))
                held = float(np.isin(other, own).mean()) if len(other) else 0.0
                if held >= COPY_SHARE:
                    for column, value in zip(out, (key, release, held), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["id", "release_id", "held"])

    # the ids go to the texts, so a file that is no suspect is dropped before its text is sorted
    own = files.select("id", "path", F.col("content").alias("mine"))
    other = releases.select(F.col("id").alias("release_id"), F.col("path").alias("other_path"), "content")
    texts = pairs.join(own, "id").join(other, "release_id").select("id", "release_id", "path", "mine", "other_path", "content")
    held = texts.mapInArrow(run, "id bigint, release_id bigint, held double")
    return held.groupBy("id").agg(F.max(F.struct("held", (-F.col("release_id")).alias("less"))).alias("best")).select("id", (-F.col("best.less")).alias("release_id"), F.col("best.held").alias("held"))


def not_hand_written(families: DataFrame) -> DataFrame:
    """``file_id, kind``: vendored (verified copy of a release in its family), else what the family decides, else, where the
    family decides nothing, what its masked tokens cannot show: the file's own notice, layout or file marks."""
    kind = F.when(F.col("release_id").isNotNull(), "vendored").when(F.col("family_kind") != "", F.col("family_kind")).when(F.col("hidden"), F.col("vote")).otherwise("")
    return families.select("file_id", kind.alias("kind")).filter("kind <> ''")


def import_origins(imports: DataFrame, files: DataFrame, found: DataFrame) -> DataFrame:
    """``repo, stated, imports, resolved, not_hand_written``: imports by whether they say they lead to the trusted library
    (is_openzeppelin: true, false or null), how many name a file that was archived, and how many of those lead to text that
    nobody on the project wrote. The last part of the path names the file within the repository."""
    own = files.select("file_id", "repo", F.col("path")).dropDuplicates(["file_id"])
    named = own.join(found, "file_id", "left").select("repo", F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.col("kind").isNotNull().cast("int").alias("foreign"))
    by_name = named.groupBy("repo", "name").agg(F.max("foreign").alias("foreign"))
    rows = imports.select("import_id", "file_id", F.regexp_extract("path", r"[^/]+$", 0).alias("name"), "is_openzeppelin").dropDuplicates(["import_id"]).join(own.select("file_id", "repo"), "file_id")
    joined = rows.join(by_name, ["repo", "name"], "left")
    return joined.groupBy("repo", F.col("is_openzeppelin").alias("stated")).agg(F.count(F.lit(1)).alias("imports"), F.count("foreign").alias("resolved"), F.coalesce(F.sum("foreign"), F.lit(0)).alias("not_hand_written"))
