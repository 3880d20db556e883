"""A library of datasets: from a folder of documents to answers.

Everything a dataset owns is a table below the library's root folder. The
methods here only decide what to run and where results go; the work is done
by the operators, on the executors.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quillframe.functions import text as tx
from quillframe.model import ExtractionSummary, QueryResult, RecordSchema, typed_struct
from quillframe.operators import catalog, contracts, extraction, search, sinks
from quillframe.operators.query import PAGE_ROWS, Workspace
from quillframe.session import configure, materialise
from quillframe.sources import ingest, large_text, listing
from quillframe.sources.registry import ParserRegistry

#: Tables of a dataset that move with it; files for reading are written anew.
CHILD_TABLES = ("documents", "ingest_errors", "preview", "records")
LEFT_OUT = "left_out"


class Library:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        user_id: str = "local",
        registry: ParserRegistry | None = None,
    ) -> None:
        self.spark = configure(spark)
        self.root = root.rstrip("/")
        self.user_id = user_id
        self.registry = registry or ingest.default_registry()

    # -- catalog ------------------------------------------------------------------

    def _history(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(catalog.DATASETS).parquet(f"{self.root}/catalog")
            return rows.filter(F.col("user_id") == self.user_id)
        except AnalysisException:
            return self.spark.createDataFrame([], catalog.DATASETS)

    def _current(self) -> DataFrame:
        return catalog.current_rows(self._history()).filter(~F.col("deleted"))

    def _save(self, row: dict[str, Any], **changes: Any) -> None:
        row = {**row, **changes, "updated_at": datetime.now(timezone.utc)}
        self.spark.createDataFrame([row], catalog.DATASETS).coalesce(1).write.mode(
            "append"
        ).parquet(f"{self.root}/catalog")

    def create_dataset(self, name: str, source_folder: str | None = None) -> str:
        dataset_id = str(uuid.uuid4())
        self._save(
            {
                "dataset_id": dataset_id,
                "user_id": self.user_id,
                "name": name,
                "status": "draft",
                "created_at": datetime.now(timezone.utc),
                "source_folder": source_folder,
                "schema_json": None,
                "deleted": False,
            }
        )
        return dataset_id

    def load(self, dataset_id: str) -> Row:
        row = self._current().filter(F.col("dataset_id") == dataset_id).first()
        if row is None:
            raise FileNotFoundError(f"no dataset {dataset_id}")
        return row

    def list_datasets(self) -> DataFrame:
        """Live datasets with their document counts, kept in the catalog folder."""
        current = self._current()
        try:
            counts = self.spark.read.parquet(f"{self.root}/documents").select("dataset_id")
        except AnalysisException:
            counts = current.select("dataset_id").limit(0)
        return catalog.summary(current, counts)

    def delete_dataset(self, dataset_id: str) -> bool:
        """False if there is no such dataset, which is not an error."""
        try:
            row = self.load(dataset_id)
        except FileNotFoundError:
            return False
        self._save(row.asDict(), deleted=True)
        return True

    def update_status(self, dataset_id: str, status: str) -> None:
        row = self.load(dataset_id)
        catalog.check_transition(row.status, status, row.schema_json is not None)
        self._save(row.asDict(), status=status)

    def state(self, dataset_id: str) -> dict[str, Any]:
        """Name, status, and document, field and extraction counts."""
        row = self.load(dataset_id)
        schema = self.schema(dataset_id)
        facts: dict[str, Any] = {
            "name": row["name"],
            "status": row.status,
            "documents": self.documents(dataset_id).count(),
            "fields": schema.field_names if schema else [],
        }
        records = self._read(dataset_id, "records")
        if records is not None:
            facts["extraction"] = extraction.summary(records)
        return facts

    # -- a dataset's tables -------------------------------------------------------

    def _path(self, dataset_id: str, name: str) -> str:
        return f"{self.root}/{name}/dataset_id={dataset_id}"

    def _read(self, dataset_id: str, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._path(dataset_id, name))
        except AnalysisException:
            return None

    def documents(self, dataset_id: str) -> DataFrame:
        docs = self._read(dataset_id, "documents")
        if docs is None:
            return self.spark.createDataFrame(
                [],
                "document_id string, path string, filename string, file_type string, "
                "content string, metadata map<string,string>, doc_index long",
            )
        return docs

    def blocks(self, dataset_id: str) -> DataFrame:
        return ingest.blocks(self.documents(dataset_id), self.registry)

    def records(self, dataset_id: str) -> DataFrame:
        records = self._read(dataset_id, "records")
        if records is None:
            raise ValueError("nothing was extracted yet")
        return records

    # -- source files and ingest ----------------------------------------------------

    def _folder(self, dataset_id: str) -> str:
        folder = self.load(dataset_id).source_folder
        if not folder:
            raise ValueError("this dataset has no source folder")
        return folder

    def list_source_files(self, dataset_id: str, pattern: str = "*") -> DataFrame:
        found = listing.list_source_files(self.spark, self._folder(dataset_id), pattern)
        return found.orderBy("path").select("name", "extension", "size")

    def _one_file(self, dataset_id: str, filename: str) -> DataFrame:
        folder = self._folder(dataset_id)
        files = listing.read_files(self.spark, folder, filename.rsplit("/", 1)[-1])
        named = files.filter(
            F.col("path").endswith(f"/{filename}")
        )
        direct = listing.in_folder(named, folder)
        chosen = named if direct.isEmpty() else direct
        return chosen.orderBy("path").limit(1)

    def read_file_sample(
        self, dataset_id: str, filename: str, max_lines: int = 50
    ) -> DataFrame:
        text = tx.decode_lossy(F.col("content"))
        file = self._one_file(dataset_id, filename).withColumn("content", text)
        return listing.file_sample(file, "path", max_lines=max_lines)

    def get_file_info(self, dataset_id: str, filename: str) -> Row:
        info = listing.file_info(self._one_file(dataset_id, filename)).first()
        if info is None:
            raise FileNotFoundError(f"no file {filename}")
        if info.modified is None:  # an empty file
            changed = listing.modified_at(self.spark, info.path)
            return Row(**{**info.asDict(), "modified": changed})
        return info

    def ingest(self, dataset_id: str, extensions: str = "") -> tuple[int, int]:
        """(documents added, files failed). A dataset is filled once; use
        :meth:`append` for later files, or :mod:`quillframe.streaming.ingest` for
        folders that keep growing."""
        if self._read(dataset_id, "documents") is not None:
            return 0, 0
        docs, errors = ingest.read_folder(
            self.spark, self._folder(dataset_id), extensions, self.registry
        )
        docs.write.parquet(self._path(dataset_id, "documents"))
        errors.write.mode("overwrite").parquet(self._path(dataset_id, "ingest_errors"))
        self._save(self.load(dataset_id).asDict())
        return (
            self.documents(dataset_id).count(),
            self._read(dataset_id, "ingest_errors").count(),
        )

    def append(self, dataset_id: str, folder: str = "", extensions: str = "") -> tuple[int, int]:
        """(documents added, files failed) of the files of a folder, the dataset's
        own by default, whose path the dataset does not have yet."""
        docs = self.documents(dataset_id)
        fresh, errors = ingest.read_folder(
            self.spark,
            folder or self._folder(dataset_id),
            extensions,
            self.registry,
            known=docs.select("path"),
        )
        added = materialise(ingest.numbered_after(docs, fresh), "appended")
        failed = materialise(errors, "append-errors")
        n = added.count()
        if n or self._read(dataset_id, "documents") is None:
            added.write.mode("append").parquet(self._path(dataset_id, "documents"))
        failed.write.mode("append").parquet(self._path(dataset_id, "ingest_errors"))
        self._save(self.load(dataset_id).asDict())
        return n, failed.count()

    def ingest_errors(self, dataset_id: str, limit: int = 10) -> DataFrame:
        """The first errors in path order, as many as are shown to a user."""
        errors = self._read(dataset_id, "ingest_errors")
        if errors is None:
            raise ValueError("nothing was ingested yet")
        return errors.orderBy("path").limit(limit)

    def list_documents(self, dataset_id: str) -> DataFrame:
        return ingest.list_documents(self.documents(dataset_id)).orderBy("doc_index")

    def read_document(
        self, dataset_id: str, reference: str, max_chars: int = 3000
    ) -> Row:
        found = ingest.read_document(self.documents(dataset_id), reference, max_chars)
        row = found.first()
        if row is None:
            raise FileNotFoundError(f"no document {reference}")
        return row

    # -- schema and extraction --------------------------------------------------------

    def schema(self, dataset_id: str) -> RecordSchema | None:
        text = self.load(dataset_id).schema_json
        return RecordSchema.from_json(text) if text else None

    def set_schema(self, dataset_id: str, schema_json: str) -> RecordSchema:
        """Validate and store a schema as the dataset's next version."""
        try:
            schema = RecordSchema.from_json(schema_json)
        except (ValueError, KeyError, TypeError) as problem:
            raise ValueError(f"not a schema in JSON: {problem}") from problem
        problems = contracts.validate_schema(self.spark, schema)
        if problems:
            raise ValueError("the schema is not valid: " + "; ".join(problems))
        before = self.schema(dataset_id)
        schema = schema.with_version(before.version + 1 if before else 1)
        row = self.load(dataset_id)
        self._save(row.asDict(), schema_json=schema.to_json())
        if row.status == "draft" and not self.documents(dataset_id).isEmpty():
            self.update_status(dataset_id, "schema_ready")
        return schema

    def _ready(self, dataset_id: str) -> tuple[DataFrame, RecordSchema]:
        schema = self.schema(dataset_id)
        if schema is None or not schema.fields:
            raise ValueError("this dataset has no schema yet")
        docs = self.documents(dataset_id)
        if docs.isEmpty():
            raise ValueError("this dataset has no documents yet")
        return extraction.skip_non_records(docs), schema

    def extract_sample(
        self, dataset_id: str, strategy: extraction.Strategy, sample_size: int = 3
    ) -> DataFrame:
        """Records of the first documents, as preview lines."""
        docs, schema = self._ready(dataset_id)
        records = extraction.extract_sample(docs, schema, strategy, sample_size)
        records.write.mode("overwrite").parquet(self._path(dataset_id, "preview"))
        if self.load(dataset_id).status == "schema_ready":
            self.update_status(dataset_id, "previewed")
        return extraction.preview_fields(self._read(dataset_id, "preview")).orderBy(
            "doc_index", "position"
        )

    def extract_all(self, dataset_id: str, strategy: extraction.Strategy) -> ExtractionSummary:
        """Extract every document once, then write all sinks from the result.

        The records also keep what their typed data cannot hold, in ``left_out``.
        """
        docs, schema = self._ready(dataset_id)
        extraction.extract_batch(docs, schema, strategy, LEFT_OUT).write.mode(
            "overwrite"
        ).parquet(self._path(dataset_id, "records"))
        records = self._typed_records(dataset_id, schema)
        self._write_sinks(dataset_id, records, schema)
        if "extracted" in catalog.TRANSITIONS[self.load(dataset_id).status]:
            self.update_status(dataset_id, "extracted")
        return extraction.summary(records)

    def _typed_records(self, dataset_id: str, schema: RecordSchema) -> DataFrame:
        shape = extraction.record_type(typed_struct(schema))
        return self.spark.read.schema(shape).parquet(self._path(dataset_id, "records"))

    def _write_sinks(self, dataset_id: str, records: DataFrame, schema: RecordSchema) -> None:
        """All files of a result, whatever its size."""
        sinks.write_csv(records, schema, self._path(dataset_id, "csv") + "/data.csv")
        sinks.write_parquet(records, schema, self._path(dataset_id, "parquet") + "/data.parquet")
        sinks.dump_lines(records, schema).write.mode("overwrite").parquet(
            self._path(dataset_id, "dump")
        )
        sinks.write_dump(
            self._read(dataset_id, "dump"), self._path(dataset_id, "text") + "/data.txt"
        )

    # -- questions -----------------------------------------------------------------------

    def search(
        self,
        dataset_id: str,
        pattern: str,
        max_results: int = search.MAX_RESULTS,
        shown_chars: int | None = search.SHOWN_CHARS,
    ) -> DataFrame:
        """Matching lines of all source files, whatever their type, size or
        encoding, then of the extracted records."""
        dump, folder = self._read(dataset_id, "dump"), self.load(dataset_id).source_folder
        try:
            lines = large_text.numbered_lines(self.spark, folder) if folder else None
        except AnalysisException:
            lines = None  # an imported dataset's folder need not be here
        if lines is None:
            lines = listing.lines(self.documents(dataset_id), "path", "filename")
        return search.search_all(lines, dump, pattern, max_results, shown_chars)

    def table_name(self, dataset_id: str) -> str:
        name = F.lit(self.load(dataset_id)["name"])
        return self.spark.range(1).select(tx.table_name(name)).first()[0]

    def workspace(self, dataset_id: str) -> Workspace:
        """SQL over the dataset's records, one column per schema field."""
        schema = self.schema(dataset_id)
        ws = Workspace(self.spark)
        records = ws.spark.read.parquet(self._records_path(dataset_id))
        rows = sinks.flat_columns(sinks.kept_records(records), schema)
        rows.createOrReplaceTempView(self.table_name(dataset_id))
        return ws

    def _records_path(self, dataset_id: str) -> str:
        self.records(dataset_id)  # raises if nothing was extracted
        return self._path(dataset_id, "records")

    def query_sql(
        self, dataset_id: str, sql: str, limit: int = PAGE_ROWS, offset: int = 0
    ) -> QueryResult:
        return self.workspace(dataset_id).execute_sql(sql, limit, offset)

    # -- moving datasets --------------------------------------------------------------------

    def export_dataset(self, dataset_id: str, path: str) -> str:
        """The dataset with all its tables as one folder."""
        tables = {"datasets": self._current()}
        for name in CHILD_TABLES:
            table = self._read(dataset_id, name)
            if table is not None:
                tables[name] = table.withColumn("dataset_id", F.lit(dataset_id))
        return sinks.export_snapshot(tables, dataset_id, path)

    def import_dataset(self, path: str) -> str:
        dataset_id, tables = sinks.import_snapshot(self.spark, path, ("datasets",))
        for name in CHILD_TABLES:
            try:
                table = self.spark.read.parquet(f"{path}/{name}")
            except AnalysisException:
                continue  # the dataset had none
            table.drop("dataset_id").write.mode("overwrite").parquet(
                self._path(dataset_id, name)
            )
        row = tables["datasets"].first().asDict()
        self._save(row, user_id=self.user_id)
        if self._read(dataset_id, "records") is not None and row["schema_json"]:
            schema = RecordSchema.from_json(row["schema_json"])
            self._write_sinks(dataset_id, self._typed_records(dataset_id, schema), schema)
        return dataset_id
