"""Verdicts kept up to date while documents arrive and rules change.

Three tables lie below a folder, each with a folder per batch:

* ``rules``: the active rules with ``since``, the batch from which their present definition counts;
* ``documents``: the checked columns of the documents that arrived, by discipline;
* ``verdicts``: per document a list of verdicts, by discipline. An arrival gets those of all its rules, a document judged
  before those of the changed rules that apply to it.

A verdict counts if its rule is still active and the verdict is not older than the rule. A changed or dropped rule thus
retracts all its verdicts by one row of ``rules``; nothing that was written is read or rewritten for it. To judge a changed rule,
a batch reads the documents of that rule's discipline and those without a discipline; a rule for all disciplines is judged on all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.constants import BLOCKING
from paperloom.operators.validation import ALL_RULES, INPUT_COLUMNS, judged
from paperloom.streaming.known import exists, is_complete

_DEFINITION = ["name", "rule_type", "discipline", "def_type", "def_field", "def_pattern"]
# The column that documents and verdicts are laid out by.
_KEY = "rules_of"
_INPUTS = "id {id}, document_number string, title string, revision string, issue_status string, contract_number string, discipline string, page_count int"
_VERDICTS = (
    "document_id {id}, document_number string, arrived boolean, verdicts array<struct<rule_id:bigint,rule_name:string,"
    "rule_type:string,passed:boolean,message:string,details:map<string,string>>>"
)
# Both are read with the layout's columns as they were written, whatever their values look like.
_LAYOUT = f", batch_id bigint, {_KEY} string"


def definition_hash() -> Column:
    """Of all that decides a rule's verdicts; nulls differ from empty texts."""
    return F.sha2(F.to_json(F.struct(*_DEFINITION)), 256)


class VerdictTable:
    """Verdicts of all documents that arrived, under the rules of the latest batch.

    Batches are numbered upwards. A batch that is run again leaves what it had completed: the rules it had read count, and nothing
    is judged twice. A document arrives once; a corrected one is a new document, as in admission. Rules take effect with the
    next batch, which may have no arrivals (``commit`` of an empty table).
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type

    def _folder(self, table: str, batch_id: int) -> str:
        return f"{self.path}/{table}/batch_id={batch_id}"

    def batches(self) -> list[int]:
        """Numbers of the complete batches, in order."""
        root = f"{self.path}/verdicts"
        if not exists(self.spark, root):
            return []
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(root)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)
        numbers = [int(n.split("=")[1]) for n in (f.getPath().getName() for f in files) if "=" in n]
        return sorted(n for n in numbers if is_complete(self.spark, self._folder("verdicts", n)))

    def _write(self, df: DataFrame, table: str, batch_id: int, *by: str) -> None:
        folder = self._folder(table, batch_id)
        if not is_complete(self.spark, folder):
            df.write.mode("overwrite").partitionBy(*by).parquet(folder)

    def rules(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(self._folder("rules", batch_id))

    def _read(self, table: str, columns: str, batches: list[int]) -> DataFrame:
        rows = self.spark.read.schema(columns.format(id=self.id_type) + _LAYOUT).parquet(f"{self.path}/{table}")
        return rows.where(F.col("batch_id").isin(batches))

    def affected(self, changed: DataFrame) -> list[str] | None:
        """Keys of the disciplines whose documents changed rules can judge; None for all of them."""
        disciplines = [r[0] for r in changed.select("discipline").distinct().collect()]  # as few as there are disciplines
        return None if None in disciplines else [*disciplines, ALL_RULES]

    def commit(self, batch_id: int, arrivals: DataFrame, rules: DataFrame) -> None:
        """Take in the documents of a batch and the rules as they are now."""
        if is_complete(self.spark, self._folder("verdicts", batch_id)):
            return
        earlier = [n for n in self.batches() if n < batch_id]
        active = rules.where("active").select(F.col("id").cast("long").alias("id"), *_DEFINITION, "active")
        active = active.withColumn("definition", definition_hash())
        if earlier:
            known = self.rules(earlier[-1]).select("id", "definition", F.col("since").alias("known"))
            active = active.join(F.broadcast(known), ["id", "definition"], "left")  # rules are packed into single rows anyway
        else:
            active = active.withColumn("known", F.lit(None).cast("long"))
        since = F.coalesce("known", F.lit(batch_id).cast("long")).alias("since")
        self._write(active.select("id", *_DEFINITION, "active", "definition", since).coalesce(1), "rules", batch_id)
        current = self.rules(batch_id)

        key = F.coalesce(F.nullif("discipline", F.lit("")), F.lit(ALL_RULES)).alias(_KEY)
        inputs = [F.col("id").cast(self.id_type).alias("id"), *INPUT_COLUMNS[:-1], F.col("page_count").cast("int")]
        self._write(arrivals.select(*inputs, key), "documents", batch_id, _KEY)

        found = judged(self._read("documents", _INPUTS, [batch_id]), current).withColumn("arrived", F.lit(True))
        changed = current.where(F.col("since") == batch_id)
        if earlier and not changed.isEmpty():
            before, keys = self._read("documents", _INPUTS, earlier), self.affected(changed)
            before = before if keys is None else before.where(F.col(_KEY).isin(keys))
            again = judged(before, changed).where(F.size("verdicts") > 0)
            found = found.unionByName(again.withColumn("arrived", F.lit(False)))
        columns = [F.col("id").alias("document_id"), "document_number", "arrived", "verdicts", _KEY]
        self._write(found.select(*columns), "verdicts", batch_id, _KEY)

    def verdicts(self) -> DataFrame:
        """Lists of the verdicts that count, one or more per document: document_id, document_number, arrived, verdicts."""
        done = self.batches()
        if not done:
            raise ValueError(f"no batch was committed to {self.path}")
        entries = F.collect_list(F.struct("id", "since"))
        since = F.map_from_entries(self.rules(done[-1]).agg(entries.alias("e")).select("e").scalar())
        counts = lambda v: F.coalesce(F.col("batch_id") >= F.try_element_at(F.col("since"), v["rule_id"]), F.lit(False))
        return (
            self._read("verdicts", _VERDICTS, done)
            .withColumn("since", since)
            .withColumn("verdicts", F.filter("verdicts", counts))
            .drop("since", "batch_id", _KEY)
        )

    def validated(self) -> DataFrame:
        """The columns of ``validate_documents`` for all documents that arrived."""
        in_order = lambda v: F.array_sort(v, lambda a, b: F.when(a["rule_id"] < b["rule_id"], -1).when(a["rule_id"] > b["rule_id"], 1).otherwise(0))
        whole = self.verdicts().groupBy("document_id").agg(
            F.max("document_number").alias("document_number"), in_order(F.flatten(F.collect_list("verdicts"))).alias("verdicts")
        )
        failed = lambda blocking: F.filter("verdicts", lambda v: ~v["passed"] & ((v["rule_type"] == BLOCKING) == F.lit(blocking)))
        return whole.select(
            "document_id", "document_number", F.size("verdicts").alias("rules_evaluated"),
            failed(True).alias("failed_rules"), failed(False).alias("warnings"),
        ).withColumn("rules_failed", F.size("failed_rules")).withColumn("passed", F.col("rules_failed") == 0)

    def rule_totals(self) -> DataFrame:
        """Documents judged and failed per rule, without putting the verdicts of a document together."""
        return (
            self.verdicts().select(F.inline("verdicts"))
            .groupBy("rule_id", "rule_name", "rule_type")
            .agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(~F.col("passed")).alias("failed"))
        )
