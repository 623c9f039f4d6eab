"""The semantic index: generations of window vectors behind a pointer, each a list of parts."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Collection, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.search import document
from parley.operators.vectors import VECTORS, Embedder, archive_revision, content_hash, digest_sums, embedded, nearest, reused_or_pending, revision_of, semantic_hits
from parley.plans.store import PART, POINTER, Files, by_part, valid_name
from parley.schema import DEFAULT_LIMIT, IndexCorrupt, IndexMissing, IndexStale, NotConfirmed

FIELDS = ("embedder_id", "dimension", "archive_revision", "semantic_units", "embedded_texts", "completed_at")
#: What a generation keeps of a part: the generation that wrote it, sums of its rows' digests, a digest of its files,
#: and the change of the archive whose windows it was made from.
PART_FIELDS = ("tag", "low", "high", "n", "files", "source")


@dataclass(frozen=True)
class Archived:
    """Windows as an archive keeps them."""

    version: int
    #: The change that wrote each part: while it is the same, so are the part's windows.
    written: dict[str, str]
    #: The windows of some parts, with the column PART.
    read: Callable[[Collection[str]], DataFrame]


class SemanticIndex:
    """Builds, checks and searches generations below a folder.

    Vectors lie in the parts in which the archive keeps the windows.  A generation says for
    each part which generation wrote it, so that a build writes only parts that changed.
    """

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder):
        self.spark, self.embedder, self.files = spark, embedder, Files(spark, root)

    def _current(self) -> str:
        if not self.files.exists(POINTER):
            raise IndexMissing("no index has been built")
        name = self.files.read(POINTER).strip()
        if not valid_name(name) or not self.files.exists(f"generations/{name}"):
            raise IndexCorrupt("the pointer names no generation")
        return name

    def cursor(self) -> dict:
        """The facts of the current generation."""
        name = self._current()
        try:
            found = json.loads(self.files.read(f"generations/{name}/cursor.json"))
        except Exception as e:
            raise IndexCorrupt("the generation has no readable cursor") from e
        if any(k not in found for k in FIELDS):
            raise IndexCorrupt("the cursor lacks fields")
        return found

    def parts(self, name: str | None = None) -> dict[str, dict]:
        """PART_FIELDS of the parts of a generation, of the current one if none is named."""
        try:
            found = json.loads(self.files.read(f"generations/{name or self._current()}/parts.json"))
        except IndexMissing:
            raise
        except Exception as e:
            raise IndexCorrupt("the generation has no readable list of parts") from e
        if any(k not in t for t in found.values() for k in PART_FIELDS):
            raise IndexCorrupt("the list of parts lacks fields")
        return found

    def folder(self, part: str, tag: str) -> str:
        return self.files.at(f"vectors/{tag}/{PART}={part}")

    def _read(self, parts: dict[str, dict], tolerant: bool = False) -> DataFrame:
        """The vectors of some parts, with the column PART; ``tolerant``: files that can't be read are left out."""
        folders = [self.folder(p, t["tag"]) for p, t in sorted(parts.items())]
        if not folders:
            return self.spark.createDataFrame([], f"{VECTORS}, {PART} string")
        try:
            rows = self.spark.read.schema(VECTORS).option("ignoreCorruptFiles", tolerant).parquet(*folders)
        except AnalysisException as e:
            raise IndexCorrupt("a part of the generation isn't there") from e
        return rows.withColumn(PART, _part_of(F.col("_metadata.file_path")))

    def vectors(self) -> DataFrame:
        return self._read(self.parts()).drop(PART)

    def plan(self, windows: DataFrame) -> DataFrame:
        """What an index run would do with each window, without doing it: reuse or embed, and the document's name."""
        try:
            prior = self.vectors().select("chunk_id", "content_hash", F.lit(True).alias("vector"))
        except (IndexMissing, IndexCorrupt):
            prior = self.spark.createDataFrame([], "chunk_id string, content_hash string, vector boolean")
        rows = reused_or_pending(windows, prior)
        action = F.when(F.col("vector").isNull(), "embed").otherwise("reuse")
        return rows.select(F.col("parent_id").alias("chunk_id"), action.alias("action"), F.concat("parent_id", F.lit(".md")).alias("path"))

    def _held(self, vectors: DataFrame) -> dict[str, tuple[int, int, int]]:
        """The sums of the digests of each part's vectors; those of another dimension make a part's sums like no other's."""
        wrong = F.count_if(F.coalesce(F.size("vector") != self.embedder.dimension, F.lit(True)))
        return _sums(vectors, "chunk_id", F.col("content_hash"), wrong)

    def _files(self, tags: Iterable[str]) -> dict[tuple[str, str], str]:
        """A digest of names and lengths of the files of each part that a generation wrote: files are listed, not read."""
        roots = [self.files.at(f"vectors/{t}") for t in sorted(set(tags)) if self.files.exists(f"vectors/{t}")]
        if not roots:
            return {}
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(roots)
        tag, name = (F.regexp_extract("path", rf"([^/]+)/{PART}=[^/]+/([^/]+)$", k) for k in (1, 2))
        each = listed.select(tag.alias("tag"), _part_of(F.col("path")).alias(PART), F.struct(name.alias("name"), "length").alias("file"))
        found = each.groupBy("tag", PART).agg(F.sha2(F.to_json(F.sort_array(F.collect_list("file"))), 256).alias("files"))
        return {(r["tag"], r[PART]): r["files"] for r in found.collect()}

    def verify(self, windows: DataFrame, version: int | None = None) -> str:
        """The current generation's name; raises unless it holds exactly the windows' ids and contents.

        A generation is checked when it is built.  Where ``version``, the archive's, is
        still the one that it was built from, nothing is read again.
        """
        name, found = self._current(), self.cursor()
        if found["embedder_id"] != self.embedder.id or found["dimension"] != self.embedder.dimension:
            raise IndexStale("the index was built by another embedder")
        if version is not None and found.get("archive_version") == version:
            return name
        if found["archive_revision"] != archive_revision(windows):
            raise IndexStale("the archive has changed since the index was built")
        parts = self.parts(name)
        if self._held(self._read(parts)) != {p: _digest(t) for p, t in parts.items()}:
            raise IndexCorrupt("the generation doesn't hold what its cursor says")
        return name

    def build(self, windows: DataFrame | Archived, full: bool = False) -> dict:
        """Publish a generation for the windows, reusing vectors whose text is unchanged unless ``full``.

        A part is taken over as it is if its files are those that were written, by name
        and length, and its windows are those that it was made from: the archive hasn't
        written them since, or has written the same.  Other parts are made anew, with the
        vectors of unchanged texts.  ``self_healed`` says whether what was there differed
        from the windows, or was damaged.  What was written is checked before the pointer
        is moved.  What the generation before holds stays for its readers until the next.
        """
        source = windows if isinstance(windows, Archived) else None
        with self.files.lock() as lease:
            old, before, damaged = self._prior()
            if full:
                old, damaged = {}, False
            present = self._files(t["tag"] for t in old.values())
            sound = {p for p, t in old.items() if present.get((t["tag"], p)) == t["files"]}
            same = {p for p in sound if source and source.written.get(p) == old[p]["source"]}
            rows = source.read(set(source.written) - same) if source else by_part(windows, "chat_id", "started_at")
            sums = _sums(rows, "parent_id", content_hash(F.col("text")))
            kept = {p: old[p] for p in sound if p in same or sums.get(p) == _digest(old[p])}
            changed, replaced = set(sums) - set(kept), set(old) - set(kept)
            name = f"g{uuid.uuid4().hex}"
            try:
                new, made = 0, {}
                if changed:
                    rows = source.read(changed) if source else rows.filter(F.col(PART).isin(changed))
                    prior = self._read({p: old[p] for p in replaced if (old[p]["tag"], p) in present}, tolerant=True).drop(PART)
                    prior = prior.filter(F.size("vector") == self.embedder.dimension).dropDuplicates(["chunk_id", "content_hash"])
                    new = self._write(name, reused_or_pending(rows, prior), rows)
                    written = self._files([name])
                    made = {p: {"tag": name, **dict(zip(("low", "high", "n"), sums[p])), "files": written.get((name, p))} for p in changed}
                    if self._held(self._read(made)) != {p: sums[p] for p in changed}:
                        raise IndexStale("the archive changed while the index was built")
                parts = {p: {**t, "source": source.written.get(p) if source else None} for p, t in (kept | made).items()}
                units = sum(t["n"] for t in parts.values())
                facts = {
                    "embedder_id": self.embedder.id,
                    "dimension": self.embedder.dimension,
                    "archive_revision": revision_of(map(_digest, parts.values())),
                    "archive_version": source.version if source else None,
                    "semantic_units": units,
                    "embedded_texts": new,
                    "completed_at": dt.datetime.now(dt.UTC).isoformat(),
                }
                generation = Files(self.spark, self.files.at(f"generations/{name}"))
                generation.write("parts.json", json.dumps(parts, sort_keys=True))
                generation.write("cursor.json", json.dumps(facts, sort_keys=True))
                lease.check()
                self.files.write(POINTER, name)
            except Exception:
                for kind in ("generations", "vectors", "documents"):
                    self.files.delete(f"{kind}/{name}")
                raise
            self._sweep({name: parts, **before})
            return {**facts, "reused": units - new, "self_healed": damaged or bool(old) and bool(changed or replaced)}

    def _prior(self) -> tuple[dict[str, dict], dict[str, dict], bool]:
        """The parts that a build may take over, the current generation with its parts, and whether that can't be used."""
        before: dict[str, dict] = {}
        try:
            name = self._current()
            before = {name: {}}
            before[name] = self.parts(name)
            cursor = self.cursor()
        except IndexMissing:
            return {}, before, False
        except Exception:  # noqa: BLE001  a damaged generation of any kind is built anew
            return {}, before, True
        if cursor["embedder_id"] != self.embedder.id or cursor["dimension"] != self.embedder.dimension:
            return {}, before, True
        return before[name], before, False

    def _write(self, name: str, prepared: DataFrame, rows: DataFrame) -> int:
        """Write the vectors and documents of windows; the number of vectors that were made."""
        new = prepared.filter("vector is null").count()
        documents = rows.select(PART, F.concat("parent_id", F.lit(".md")).alias("name"), document(rows).alias("text"))
        for kind, made in (("vectors", embedded(prepared, self.embedder, PART)), ("documents", documents)):
            made.hint("rebalance", PART).write.partitionBy(PART).parquet(self.files.at(f"{kind}/{name}"))
        return new

    def _sweep(self, generations: dict[str, dict]) -> None:
        """Delete what is in none of the generations, what broken builds left included."""
        live = {(t["tag"], p) for parts in generations.values() for p, t in parts.items()}
        tags = {tag for tag, _ in live}
        for kind in ("vectors", "documents"):
            for tag in self.files.names(kind):
                if tag not in tags:
                    self.files.delete(f"{kind}/{tag}")
                    continue
                for folder in self.files.names(f"{kind}/{tag}"):
                    if folder.startswith(f"{PART}=") and (tag, folder.split("=", 1)[1]) not in live:
                        self.files.delete(f"{kind}/{tag}/{folder}")
        for old in self.files.names("generations"):
            if old not in generations:
                self.files.delete(f"generations/{old}")

    def search(
        self, windows: DataFrame, query: str, limit: int = DEFAULT_LIMIT, length: int = 80, version: Callable[[], int] | None = None,
        holding: Callable[[DataFrame], DataFrame] | None = None,
    ) -> DataFrame:
        """Hits by similarity; a missing, stale or damaged index is an error.

        The scan of the vectors is done here, and gives at most ``limit`` ids; then the
        index and the archive are looked at again.  ``version`` tells the archive's;
        ``holding`` gives the windows of the parts that hold rows (chat_id, started_at).
        """
        before = version() if version else None
        name = self.verify(windows, before)
        best = nearest(self._read(self.parts(name)), self.embedder, query, limit)
        if self._current() != name or version and version() != before:
            raise IndexStale("the index or the archive changed while the search was running")
        return semantic_hits(holding(best) if holding else windows, best, query, length)

    def wipe(self, confirm: bool = False) -> None:
        if not confirm:
            raise NotConfirmed("wiping the index needs confirm=True")
        self.files.delete()


def _part_of(path: Column) -> Column:
    """The part that a file's folder names."""
    return F.regexp_extract(path, rf"/{PART}=([^/]+)/[^/]+$", 1)


def _sums(rows: DataFrame, id_col: str, content: Column, *more: Column) -> dict[str, tuple[int, ...]]:
    """The sums of the rows' digests for each part, and further sums where they aren't 0: a row a part reaches the driver."""
    found = rows.groupBy(PART).agg(*digest_sums(F.col(id_col), content, F.col("started_at")), *(m.alias(f"more{k}") for k, m in enumerate(more))).collect()
    return {r[PART]: (*_digest(r), *(r[f"more{k}"] for k in range(len(more)) if r[f"more{k}"])) for r in found}


def _digest(part) -> tuple[int, int, int]:
    return int(part["low"]), int(part["high"]), int(part["n"])
