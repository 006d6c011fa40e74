"""Load of an upload batch: raw wide rows to dimensions, facts and split assignments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.functions.text import clean_specimen, first_token, lower_strip
from labspark.functions.values import PANELS, parse_date
from labspark.operators.dims import assign_keys, get_or_create, lookup_or_other, with_ids
from labspark.operators.numbering import number_rows
from labspark.operators.quality import identity, new_value_report, quality_report
from labspark.operators.reshape import ANSWER_PREFIX, RESULT_PREFIX, infer_symbol_type, melt_facts, with_sub_type
from labspark.operators.split import split_by_case, split_by_label
from labspark.session import bounded, checkpointed, distinct_values
from labspark.sources.stored import IdentityIndex


@dataclass
class Dimensions:
    """Dimension tables (id, name); antimicrobial_sir also has sir_type_id. All of one panel."""

    species: DataFrame
    bacteria_genus: DataFrame
    submitted_sample: DataFrame
    antimicrobial_sir: DataFrame
    antimicrobial_answer: DataFrame
    sir_sub_type: DataFrame


@dataclass
class Batch:
    """Rows to append and the dimensions after the load."""

    report: DataFrame
    report_sir: DataFrame
    report_answer: DataFrame
    report_train: DataFrame
    dimensions: Dimensions
    file_id: int
    created: dict[str, DataFrame]  # dimension members that came with this batch

    def tables(self) -> dict[str, DataFrame]:
        return {
            "report": self.report,
            "report_sir": self.report_sir,
            "report_answer": self.report_answer,
            "report_train": self.report_train,
            **{f"dim_{name}": rows for name, rows in self.created.items()},
        }


def normalise(upload: DataFrame) -> DataFrame:
    """Typed and cleaned report columns of a numbered upload; result and answer columns are left out."""
    return upload.select(
        "report_id",
        F.col("hn").cast("string").alias("hn"),
        parse_date(F.col("date_of_submission")).alias("date_of_submission"),
        parse_date(F.col("report_issued_date")).alias("report_issued_date"),
        lower_strip(F.col("species")).alias("species"),
        first_token(lower_strip(F.col("bacteria_genus"))).alias("bacteria_genus"),
        clean_specimen(F.col("submitted_sample")).alias("submitted_sample"),
    )


def sir_drugs(symbols: DataFrame, known: DataFrame) -> DataFrame:
    """Result drugs after the load: new ones typed by majority, ties left out."""
    fresh = symbols.join(bounded(known.select("name")), "name", "left_anti")
    typed = infer_symbol_type(fresh, ["name"]).select("name", "sir_type_id")
    keyed = assign_keys(typed, known).select("id", "name", "sir_type_id")
    return known.select(F.col("id").cast("long").alias("id"), "name", F.col("sir_type_id").cast("int")).unionByName(keyed)


def ingest(
    upload: DataFrame,
    dims: Dimensions,
    panel: int,
    file_id: int,
    last_report_id: int = 0,
    labels: list[int] | None = None,
    seed: int = 0,
) -> Batch:
    """Split a checked upload into facts.

    `upload` has line_no, the seven fixed columns and prefixed columns as texts. Report ids
    follow `last_report_id` in line order. `labels` are the answer ids to split for;
    without them all answers of the panel after the load.
    """
    # Numbered before it is taken apart: facts carry the report id and need no join. Written once on the way.
    upload = number_rows(upload, [F.col("line_no")], "report_id", last_report_id + 1)
    # Cleaned once: the dimensions and the passes of the split read the cleaned columns.
    base = checkpointed(normalise(upload))
    genus = bounded(get_or_create(base, "bacteria_genus", dims.bacteria_genus))
    sample = bounded(get_or_create(base, "submitted_sample", dims.submitted_sample))

    keyed = lookup_or_other(base, "species", dims.species, "species_id")
    keyed = with_ids(keyed, "bacteria_genus", genus, "bacteria_genus_id")
    keyed = with_ids(keyed, "submitted_sample", sample, "submitted_sample_id")
    report = keyed.select(
        "report_id", "hn", "date_of_submission", "report_issued_date", "species_id",
        "bacteria_genus_id", "submitted_sample_id", F.lit(panel).alias("vitek_id"), F.lit(file_id).alias("file_id"),
    )
    report = checkpointed(split_by_case(report, seed=seed))

    # Results and answers leave the wide rows once; dimensions and facts read the long table.
    facts = checkpointed(melt_facts(upload, ["report_id"]))
    symbols = facts.filter(F.col("kind") == RESULT_PREFIX).select("report_id", "name", F.col("value").alias("symbol"))
    drugs = bounded(sir_drugs(symbols, dims.antimicrobial_sir))
    drug_ids = drugs.select(F.col("id").alias("antimicrobial_id"), "name", "sir_type_id")
    typed = with_sub_type(symbols.join(drug_ids, "name"), dims.sir_sub_type)
    report_sir = typed.select("report_id", "antimicrobial_id", "sir_sub_id")

    flags = facts.filter(F.col("kind") == ANSWER_PREFIX).select("report_id", "name")
    answers = bounded(get_or_create(flags, "name", dims.antimicrobial_answer))
    report_answer = (
        with_ids(flags, "name", answers, "antimicrobial_id").select("report_id", "antimicrobial_id")
    )
    if labels is None:
        labels = distinct_values(answers, "id")
    report_train = split_by_label(
        report.filter("type = 'train'"), report_answer, labels, "report_id", "antimicrobial_id", seed
    ).select("report_id", F.col("antimicrobial_id").cast("long").alias("antimicrobial_id"), "sub_type")
    return Batch(
        report,
        report_sir,
        report_answer,
        report_train,
        Dimensions(dims.species, genus, sample, drugs, answers, dims.sir_sub_type),
        file_id,
        {
            name: after.join(before.select("id"), "id", "left_anti")
            for name, after, before in (
                ("bacteria_genus", genus, dims.bacteria_genus),
                ("submitted_sample", sample, dims.submitted_sample),
                ("antimicrobial_sir", drugs, dims.antimicrobial_sir),
                ("antimicrobial_answer", answers, dims.antimicrobial_answer),
            )
        },
    )


def process_upload(
    upload: DataFrame,
    dims: Dimensions,
    panel: int,
    file_id: int,
    folder: str,
    stored: DataFrame | None = None,
    last_report_id: int = 0,
    labels: list[int] | None = None,
    index: IdentityIndex | None = None,
) -> tuple[str, DataFrame, Batch | None]:
    """Check an upload, then load and store it: facts, new members, file row, log row and result rows.

    A second run of the same file_id replaces what the first one stored. Returns 'fail' with the issues, or 'success' with the new-value warnings and the batch.
    `stored` is the wide report of the active batches; without it nothing counts as stored.
    An `index` of stored identities takes its place in the search for duplicates, and takes the batch over.
    """
    upload = checkpointed(upload)
    issues = checkpointed(quality_report(upload, PANELS[panel], stored if index is None else index))
    log = "file_id long, vitek_id int, status string, amount_row long"
    if not issues.isEmpty():
        store(upload.sparkSession.createDataFrame([(file_id, panel, "fail", None)], log), folder, "upload_log", file_id)
        store(issues, folder, "upload_result", file_id)
        return "fail", issues, None
    warnings = None if stored is None else checkpointed(new_value_report(upload, stored))
    batch = ingest(upload, dims, panel, file_id, last_report_id, labels)
    append_batch(batch, folder)
    if index is not None:
        index.add(upload.select(*[c.alias(n) for n, c in identity(upload).items()]), file_id)
    done = upload.sparkSession.createDataFrame([(file_id, panel, "success", upload.count())], log)
    store(done.select("file_id", "vitek_id", "amount_row", F.lit(True).alias("active")), folder, "file", file_id)
    if warnings is not None:
        store(warnings, folder, "upload_warning", file_id)
    store(done, folder, "upload_log", file_id)
    return "success", issues if warnings is None else warnings, batch


def append_batch(batch: Batch, folder: str) -> None:
    """Store a batch: facts and new dimension members, each partitioned by batch so that snapshots prune."""
    for name, rows in batch.tables().items():
        store(rows, folder, name, batch.file_id)


def store(rows: DataFrame, folder: str, name: str, file_id: int) -> None:
    """Write the rows of one batch; rows of the same batch that are there already are replaced."""
    out = rows.withColumn("file_id", F.lit(file_id).cast("long"))
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("file_id").parquet(f"{folder.rstrip('/')}/{name}")
