"""An append log: batches of records that readers see once they are committed, in the order of their commits."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.prep import keep_first
from ..storage import exists, publish, unused
from .lines import parsed_lines

_COMMIT = "seq long, token string, folder string"


class AppendLog:
    """Records of one schema under path, a folder a batch, and in path/_commits a file for each commit.

    A commit is a number, the folder that it makes visible, and a token that names what was appended. A batch is written
    first and committed then, by putting down the file of the next number: of two writers that reach for one number one
    has it, and the other looks again. So a batch whose writer dies is never seen, a batch with a token that is
    committed isn't committed again, and the order of commits is the same for all readers, whatever the clocks of
    files say. Within a batch rows have the order in which Spark wrote them: by file name and line.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def commits(self) -> DataFrame:
        """(seq, token, folder)."""
        at = f"{self.path}/_commits"
        if not exists(self.spark, at):
            return self.spark.createDataFrame([], _COMMIT)
        return self.spark.read.schema(_COMMIT).json(at)

    def append(self, df: DataFrame, token: str | None = None) -> int:
        """Append the rows and return the number of their commit. With a token that is committed already nothing is
        done, and the number is that of then."""
        known, _ = self._seen(token)
        if known is not None:
            return known
        folder = uuid.uuid4().hex
        df.select(*(F.col(f"`{f.name}`") for f in self.schema.fields)).write.json(f"{self.path}/batch={folder}")
        while True:
            # Both from one look: whoever commits the same after it takes the number that this writer reaches for.
            known, last = self._seen(token)
            if known is not None:
                return known
            if publish(self.spark, f"{self.path}/_commits/{last + 1:020d}.json", json.dumps({"seq": last + 1, "token": token, "folder": folder})):
                return last + 1

    def _seen(self, token: str | None) -> tuple[int | None, int]:
        """The number under which the token is committed, if it is, and the last number of all."""
        while True:
            own = F.min(F.when(F.col("token") == token, F.col("seq"))) if token is not None else F.lit(None).cast("long")
            got = self.commits().agg(own.alias("own"), F.max("seq").alias("last"), F.count("*").alias("n")).first()
            # A listing that runs while files come may have a later one and lack an earlier one; then look again.
            if got["n"] == (got["last"] or 0):
                return got["own"], got["last"] or 0

    def _with_place(self) -> tuple[DataFrame, str]:
        """The records, and a column by which they ascend in the order of the log."""
        commits = self.commits()
        # The folders of a table's batches, as a list of files to read.
        folders = [r.folder for r in commits.select("folder").collect()]
        (at,) = unused(self.spark.createDataFrame([], self.schema), "_at")
        if not folders:
            none = F.struct(F.lit(0).cast("long").alias("seq"), F.lit("").alias("file"), F.lit(0).cast("long").alias("line"))
            return self.spark.createDataFrame([], self.schema).withColumn(at, none), at
        rows = parsed_lines(self.spark, [f"{self.path}/batch={f}" for f in folders], self.schema)
        rows = rows.withColumn("folder", F.regexp_extract("file", "/batch=([0-9a-f]+)/[^/]*$", 1)).join(commits, "folder")
        return rows.select("record.*", F.struct("seq", "file", "line").alias(at)), at

    def read(self) -> DataFrame:
        """The records of all committed batches."""
        folders = [f"{self.path}/batch={r.folder}" for r in self.commits().select("folder").collect()]
        return self.spark.read.schema(self.schema).json(folders) if folders else self.spark.createDataFrame([], self.schema)

    def read_in_order(self) -> DataFrame:
        """All records with `seq`, the number of their commit, `file` and `line`."""
        rows, at = self._with_place()
        taken = {f.name.lower() for f in self.schema.fields} & {"seq", "file", "line"}
        if taken:
            raise ValueError(f"fields of these names: {', '.join(sorted(taken))}")
        return rows.select(*(f"`{f.name}`" for f in self.schema.fields), f"{at}.*")

    def read_first(self, key: str = "id") -> DataFrame:
        """One record for each key, the first in the order of the log. Null is a key like another."""
        rows, at = self._with_place()
        return keep_first(rows, key, at).drop(at)
