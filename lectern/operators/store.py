"""A per-user store of runs and notes over Parquet snapshots.

Each table is a folder of snapshots, of rows added since, and of commits. A change
writes its rows and then a commit, so readers see all of it or nothing: added rows
are written alone and merged by the reader, other changes write a new snapshot.
Many additions become one snapshot, and folders that neither of the last two
snapshots needs are deleted. Ids grow and are never used again: the commit
carries the last one.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import schemas
from lectern.functions.text import json_or_raw, strip

TABLES = {"users": schemas.USERS, "article_history": schemas.HISTORY, "vocabulary_notes": schemas.NOTES}
#: Commits of added rows until they become one snapshot.
ADDITIONS = 32
_JSON = ("extracted_vocabulary", "new_vocabulary", "metadata")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(x: Column) -> Column:
    """Lower case of ASCII letters alone."""
    return F.translate(x, _UPPER, _LOWER)


def like(x: Column, query: str) -> Column:
    """Contains the query, ASCII case aside; % and _ in it are wildcards, and a backslash is itself."""
    return F.call_function("like", folded(x), folded(F.lit("%" + query.replace("\\", "\\\\") + "%")))


def owned(user_id: int | None) -> Column:
    return F.lit(True) if user_id is None else F.col("user_id") == user_id


def page(rows: DataFrame, order: str, limit: int, offset: int) -> DataFrame:
    """Newest first by text of the time, then by id; a limit under 1 is 1, an offset under 0 is 0."""
    return rows.orderBy(F.desc(order), F.desc("id")).offset(max(0, offset)).limit(max(1, limit))


def now() -> str:
    return datetime.now(UTC).isoformat()


def _encoded(value):
    return json.dumps(value, ensure_ascii=False) if isinstance(value, list | dict) else value


def _blank(value: str | None) -> bool:
    return value is None or not value.strip()


class Store:
    """folder: anywhere that Spark can write. Every method is one transaction of one writer."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._path = lambda p: hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name, ddl in TABLES.items():
            if not self._versions(name):
                self._commit(name, spark.createDataFrame([], ddl), 0)

    # A commit's name: its number, the last id, what it is (s: a snapshot, d: rows added), its folder.

    def _versions(self, table: str) -> list[str]:
        at = self._path(f"{self.folder}/{table}/_commits")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _current(self, table: str) -> tuple[int, int, list[str]]:
        """Number, last id, and the folders of the last snapshot and of all rows added since."""
        commits = [v.split("-", 3) for v in self._versions(table)]
        since = max(k for k, c in enumerate(commits) if c[2] == "s")
        return int(commits[-1][0]), int(commits[-1][1]), [c[3] for c in commits[since:]]

    def read(self, table: str) -> DataFrame:
        """The current rows; columns that older ones lack are null."""
        return self.spark.read.schema(TABLES[table]).parquet(*(f"{self.folder}/{table}/{f}" for f in self._current(table)[2]))

    def _commit(self, table: str, rows: DataFrame, last: int, kind: str = "s") -> None:
        number = self._current(table)[0] + 1 if self._versions(table) else 0
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/{table}/{name}")
        made = self._fs.createNewFile(self._path(f"{self.folder}/{table}/_commits/{number:012d}-{last:012d}-{kind}-{name}"))
        if not made or sum(v.startswith(f"{number:012d}-") for v in self._versions(table)) > 1:
            raise RuntimeError(f"another writer changed {table}")
        if kind == "s":
            self._clean(table)
        elif len(self._current(table)[2]) > ADDITIONS:
            self._commit(table, self.read(table), last)

    def _clean(self, table: str) -> None:
        """Deletes what came before the last snapshot but one, which a reader may still be at."""
        versions = self._versions(table)
        snapshots = [k for k, v in enumerate(versions) if v.split("-", 3)[2] == "s"]
        for v in versions[: snapshots[-2]] if len(snapshots) > 1 else ():
            self._fs.delete(self._path(f"{self.folder}/{table}/_commits/{v}"), False)
            self._fs.delete(self._path(f"{self.folder}/{table}/{v.split('-', 3)[3]}"), True)

    def _append(self, table: str, row: dict) -> int:
        last = self._current(table)[1] + 1
        self._commit(table, self.spark.createDataFrame([{"id": last, **row}], TABLES[table]).coalesce(1), last, "d")
        return last

    def load(self, table: str, rows: DataFrame) -> None:
        """Adds rows that have their ids already, in one commit."""
        names = T._parse_datatype_string(TABLES[table]).names
        ready = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in names)).to(T._parse_datatype_string(TABLES[table]))
        self._commit(table, ready, max(self._current(table)[1], rows.agg(F.max("id")).first()[0] or 0), "d")

    def _replace(self, table: str, rows: DataFrame) -> None:
        self._commit(table, rows, self._current(table)[1])

    def _one(self, rows: DataFrame) -> dict | None:
        found = rows.limit(1).collect()
        return found[0].asDict(recursive=True) if found else None

    # Users.

    def create_user(self, username: str, password_hash: str) -> int:
        if _blank(username) or _blank(password_hash):
            raise ValueError("a user has a name and a password hash")
        if self.user_by_name(username):
            raise ValueError("this name is taken")
        return self._append("users", {"username": username.strip(), "password_hash": password_hash, "created_at": now()})

    def user_by_name(self, username: str) -> dict | None:
        return None if _blank(username) else self._one(self.read("users").where(folded(F.col("username")) == folded(F.lit(username.strip()))))

    def user_by_id(self, user_id: int) -> dict | None:
        if isinstance(user_id, bool) or not isinstance(user_id, int) or user_id < 1:
            return None
        return self._one(self.read("users").where(F.col("id") == user_id))

    # Runs.

    def save_history(self, summary: str, method: str, *, source_article_id=None, title=None, article_text=None, processing_timestamp=None, extracted_vocabulary=None, new_vocabulary=None, metadata=None, user_id=None) -> int:
        if _blank(summary) or _blank(method):
            raise ValueError("a run has a summary and a method")
        return self._append("article_history", {
            "source_article_id": source_article_id, "title": title, "article_text": article_text, "summary": summary.strip(), "method": method.strip().lower(), "processing_timestamp": processing_timestamp or now(),
            "extracted_vocabulary": _encoded(extracted_vocabulary), "new_vocabulary": _encoded(new_vocabulary), "metadata": _encoded(metadata), "user_id": user_id,
        })

    def _runs(self, method: str | None, user_id: int | None) -> DataFrame:
        rows = self.read("article_history").where(owned(user_id))
        return rows if _blank(method) else rows.where(F.col("method") == method.strip().lower())

    def _shown(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: json_or_raw(F.col(c)) for c in _JSON})

    def get_history(self, run: int, user_id: int | None = None) -> dict | None:
        return self._one(self._shown(self._runs(None, user_id).where(F.col("id") == run)))

    def list_history(self, limit: int = 20, offset: int = 0, method: str | None = None, user_id: int | None = None) -> DataFrame:
        return self._shown(page(self._runs(method, user_id), "processing_timestamp", limit, offset))

    def count_history(self, method: str | None = None, user_id: int | None = None) -> int:
        return self._runs(method, user_id).count()

    def _found_runs(self, query: str, user_id: int | None) -> DataFrame:
        if _blank(query):
            return self.read("article_history").limit(0)
        hit = F.lit(False)
        for c in ("title", "article_text", "summary", "source_article_id"):
            hit = hit | F.coalesce(like(F.col(c), query.strip()), F.lit(False))
        return self._runs(None, user_id).where(hit)

    def search_history(self, query: str, limit: int = 20, offset: int = 0, user_id: int | None = None) -> DataFrame:
        return self._shown(page(self._found_runs(query, user_id), "processing_timestamp", limit, offset))

    def count_search_history(self, query: str, user_id: int | None = None) -> int:
        return self._found_runs(query, user_id).count()

    def delete_history(self, run: int, user_id: int | None = None) -> bool:
        rows = self.read("article_history")
        gone = F.coalesce((F.col("id") == run) & owned(user_id), F.lit(False))
        if rows.where(gone).isEmpty():
            return False
        # Notes first: a reader in between sees a note without its link, never a link without its run.
        notes = self.read("vocabulary_notes")
        self._replace("vocabulary_notes", notes.withColumn("article_history_id", F.when(F.col("article_history_id") == run, None).otherwise(F.col("article_history_id"))))
        self._replace("article_history", rows.where(~gone))
        return True

    def clear_history(self, confirm: bool = False) -> int:
        if confirm is not True:
            raise ValueError("confirm=True clears the table")
        n = self.count_history()
        notes = self.read("vocabulary_notes")
        self._replace("vocabulary_notes", notes.withColumn("article_history_id", F.lit(None).cast("bigint")))
        self._replace("article_history", self.read("article_history").limit(0))
        return n

    # Notes.

    def _check_link(self, run: int | None, user_id: int | None) -> None:
        if run is not None and self._runs(None, user_id).where(F.col("id") == run).isEmpty():
            raise ValueError("no such run to link to")

    def create_note(self, content: str, *, term: str | None = None, example_sentence: str | None = None, article_history_id: int | None = None, user_id: int | None = None) -> int:
        if _blank(content):
            raise ValueError("a note has content")
        self._check_link(article_history_id, user_id)
        clean = lambda x: None if _blank(x) else x.strip()
        t = now()
        return self._append("vocabulary_notes", {"term": clean(term), "content": content.strip(), "example_sentence": clean(example_sentence), "article_history_id": article_history_id, "created_at": t, "updated_at": t, "user_id": user_id})

    def _notes(self, term: str | None, run: int | None, user_id: int | None) -> DataFrame:
        rows = self.read("vocabulary_notes").where(owned(user_id))
        if not _blank(term):
            rows = rows.where(folded(F.col("term")) == folded(F.lit(term.strip())))
        return rows if run is None else rows.where(F.col("article_history_id") == run)

    def get_note(self, note: int, user_id: int | None = None) -> dict | None:
        return self._one(self._notes(None, None, user_id).where(F.col("id") == note))

    def list_notes(self, limit: int = 20, offset: int = 0, term: str | None = None, article_history_id: int | None = None, user_id: int | None = None) -> DataFrame:
        return page(self._notes(term, article_history_id, user_id), "created_at", limit, offset)

    def count_notes(self, term: str | None = None, article_history_id: int | None = None, user_id: int | None = None) -> int:
        return self._notes(term, article_history_id, user_id).count()

    def _found_notes(self, query: str, user_id: int | None) -> DataFrame:
        if _blank(query):
            return self.read("vocabulary_notes").limit(0)
        hit = F.lit(False)
        for c in ("content", "term", "example_sentence"):
            hit = hit | F.coalesce(like(F.col(c), query.strip()), F.lit(False))
        return self._notes(None, None, user_id).where(hit)

    def search_notes(self, query: str, limit: int = 20, offset: int = 0, user_id: int | None = None) -> DataFrame:
        return page(self._found_notes(query, user_id), "created_at", limit, offset)

    def count_search_notes(self, query: str, user_id: int | None = None) -> int:
        return self._found_notes(query, user_id).count()

    def update_note(self, note: int, *, content: str | None = None, term: str | None = None, example_sentence: str | None = None, article_history_id: int | None = None, clear_term: bool = False, clear_example: bool = False, clear_link: bool = False, updated_at: str | None = None, user_id: int | None = None) -> bool:
        """Changes what is given; a clear flag beats a value; the time of change moves in any case, to updated_at or now. What is given is checked before the note is looked for."""
        if isinstance(note, bool) or not isinstance(note, int) or note < 1:
            return False
        if content is not None and _blank(content):
            raise ValueError("a note has content")
        if not clear_link:
            self._check_link(article_history_id, user_id)
        if self.get_note(note, user_id) is None:
            return False
        new = {"updated_at": F.lit(updated_at or now())}
        if content is not None:
            new["content"] = strip(F.lit(content))
        for c, value, clear, kind in (("term", term, clear_term, "string"), ("example_sentence", example_sentence, clear_example, "string"), ("article_history_id", article_history_id, clear_link, "bigint")):
            if clear or isinstance(value, str) and _blank(value):
                new[c] = F.lit(None).cast(kind)
            elif value is not None:
                new[c] = F.lit(value.strip() if isinstance(value, str) else value).cast(kind)
        rows = self.read("vocabulary_notes")
        self._replace("vocabulary_notes", rows.withColumns({c: F.when(F.col("id") == note, v).otherwise(F.col(c)) for c, v in new.items()}))
        return True

    def delete_note(self, note: int, user_id: int | None = None) -> bool:
        rows = self.read("vocabulary_notes")
        gone = F.coalesce((F.col("id") == note) & owned(user_id), F.lit(False))
        if rows.where(gone).isEmpty():
            return False
        self._replace("vocabulary_notes", rows.where(~gone))
        return True

    def clear_notes(self, confirm: bool = False) -> int:
        if confirm is not True:
            raise ValueError("confirm=True clears the table")
        n = self.count_notes()
        self._replace("vocabulary_notes", self.read("vocabulary_notes").limit(0))
        return n

    def healthy(self) -> bool:
        return self.spark.range(1).count() == 1


def envelope(rows: DataFrame, total: int, limit: int, offset: int) -> dict:
    return {"total": total, "limit": limit, "offset": offset, "items": [r.asDict(recursive=True) for r in rows.collect()]}


def page_limit(limit: int, most: int) -> int:
    """Runs are listed by up to 500, notes by up to 200."""
    if not 1 <= limit <= most:
        raise ValueError(f"a page has 1 to {most} rows")
    return limit


def page_number(offset: int, size: int) -> int:
    return offset // size + 1


def by_day(rows: DataFrame, time: str) -> DataFrame:
    """rows with the day of an ISO 8601 time in the session's time zone; null if the text is no time."""
    return rows.withColumn("day", F.date_trunc("day", F.try_to_timestamp(F.col(time))))
