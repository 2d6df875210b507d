"""A ledger of reviews: only appended to, validated, and refused if the data have changed since they were read."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.relational import latest
from ledgerloom.query.listing import BadRequest

LONGEST_KEY, LONGEST_NOTE, LONGEST_OWNER = 100, 3000, 120
SCHEMA = "review_id string, record_key string, outcome string, note string, owner string, due_date date, status string, version string, created timestamp"


class Conflict(RuntimeError):
    """The data have another version than the reviewer saw."""


@dataclass(frozen=True)
class ReviewLedger:
    """Reviews under a folder. ``records`` has the keys that can be reviewed in a column ``record_key``; ``version`` is
    the data's version now. Each review is a file of its own, so writers don't get in each other's way."""

    spark: SparkSession
    path: str
    records: DataFrame
    version: str
    outcomes: Sequence[str]
    statuses: Sequence[str]

    def checked(self, request: Mapping[str, object]) -> dict:
        """A request as a row, or an error that says what is wrong with it."""
        text = lambda name, default=None: request.get(name, default)
        key, note, owner, due = text("key"), text("note"), text("owner", ""), text("due_date", "")
        faults = [
            ("key", not isinstance(key, str) or not 1 <= len(key) <= LONGEST_KEY),
            ("note", not isinstance(note, str) or not 1 <= len(note.strip()) <= LONGEST_NOTE),
            ("outcome", text("outcome") not in self.outcomes),
            ("status", text("status", self.statuses[0]) not in self.statuses),
            ("owner", not isinstance(owner, str) or len(owner) > LONGEST_OWNER),
            ("due date", not isinstance(due, str) or (due != "" and not _is_day(due))),
        ]
        for what, wrong in faults:
            if wrong:
                raise BadRequest(f"no valid {what}")
        if text("version") != self.version:
            raise Conflict("the data have changed")
        if self.records.where(F.col("record_key") == key).isEmpty():
            raise BadRequest("no such record")
        return {"record_key": key, "outcome": text("outcome"), "note": note.strip(), "owner": owner.strip(), "due_date": date.fromisoformat(due) if due else None, "status": text("status", self.statuses[0])}

    def add(self, request: Mapping[str, object]) -> str:
        """Append a review; returns its id, which grows with time."""
        row, now = self.checked(request), datetime.now(UTC)
        name = f"{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        full = {"review_id": name, **row, "version": self.version, "created": now.replace(tzinfo=None)}
        self.spark.createDataFrame([tuple(full[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return name

    def history(self, key: str | None = None) -> DataFrame:
        """All reviews, or those of a record."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        return rows if key is None else rows.where(F.col("record_key") == key)

    def current(self) -> DataFrame:
        """The latest review of each record."""
        return latest(self.history(), ["record_key"], ["review_id"])


def _is_day(text: str) -> bool:
    try:
        return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", text)) and bool(date.fromisoformat(text))
    except ValueError:
        return False


def open_cases(reviews: DataFrame, closed: Sequence[str], text: str | None = None) -> DataFrame:
    """Current reviews that aren't closed, the newest first; ``text`` must stand in key, note or owner."""
    rows = reviews.where(~F.col("status").isin(list(closed)))
    if text:
        rows = rows.where(F.contains(F.lower(F.concat_ws("\n", "record_key", "note", "owner")), F.lit(text.lower())))
    return rows.orderBy(F.col("review_id").desc())
