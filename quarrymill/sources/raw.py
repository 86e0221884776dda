"""Raw collections: schemas, scans, flattening, and immutable writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrymill.functions import postings as P
from quarrymill.functions.text import normalized

#: Fields of a collected posting; others are dropped by the read schema.
JOB = "job_id string, job_title string, employer_name string, job_publisher string, job_employment_type string, job_is_remote boolean, job_city string, job_state string, job_country string, job_latitude double, job_longitude double, job_posted_at_datetime_utc string, job_min_salary double, job_max_salary double, job_salary_period string, job_description string, job_apply_link string"
ENVELOPE = f"role string, location string, fetched_at string, jobs array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in JOB.split(','))}>>"
OCCUPATIONS = "fetched_at string, records array<struct<occupation_code:string, title:string, total_employment:bigint, median_wage:bigint, reference_year:int>>"
_RENAMED = {
    "job_id": "job_id", "job_title": "title", "employer_name": "employer", "job_publisher": "publisher", "job_employment_type": "employment_type", "job_is_remote": "is_remote", "job_city": "city", "job_state": "state",
    "job_country": "country", "job_latitude": "latitude", "job_longitude": "longitude", "job_min_salary": "salary_min_raw", "job_max_salary": "salary_max_raw", "job_description": "description", "job_apply_link": "apply_link",
}


def read_envelopes(spark: SparkSession, glob: str, lines: bool = False) -> DataFrame:
    """Envelopes, one a file or, with `lines`, one a line."""
    return spark.read.schema(ENVELOPE).option("multiLine", not lines).json(glob)


def read_occupations(spark: SparkSession, glob: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(OCCUPATIONS).option("multiLine", not lines).json(glob)


def read_seed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV seed, all columns as text; empty values are null."""
    return spark.read.schema(", ".join(f"{c} string" for c in columns)).option("header", True).csv(path)


def flatten(envelopes: DataFrame) -> DataFrame:
    """One row a collected posting with 21 typed columns. A malformed time fails the run: ANSI mode stays on."""
    j = envelopes.select("role", "location", F.to_timestamp("fetched_at").alias("fetched_at"), F.explode("jobs").alias("j"))
    return j.select(
        *[F.col(f"j.{a}").alias(b) for a, b in _RENAMED.items()], F.to_timestamp("j.job_posted_at_datetime_utc").alias("posted_at"), F.upper("j.job_salary_period").alias("salary_period_raw"),
        F.col("role").alias("search_role"), F.col("location").alias("search_location"), "fetched_at", F.to_date("fetched_at").alias("ingest_date"))


def normalise(flat: DataFrame) -> DataFrame:
    """Adds normalised names, state code, salary flag, annual pay and the content key."""
    lo, hi, per = F.col("salary_min_raw"), F.col("salary_max_raw"), F.col("salary_period_raw")
    factor = P.literal_map(P.ANNUAL_FACTOR)[F.upper(per)]
    n = flat.withColumns({"title_normalized": normalized(F.col("title")), "employer_normalized": normalized(F.col("employer")), "state_code": P.state_code(F.col("state")), "salary_flag": P.salary_flag(lo, hi, per)})
    sound = F.col("salary_flag").isNull()
    return n.withColumns({
        "salary_min_annual": F.when(sound, F.round(lo * factor)), "salary_max_annual": F.when(sound, F.round(hi * factor)), "salary_mid_annual": F.when(sound, P.midpoint(F.round(lo * factor), F.round(hi * factor))),
        "dedup_key": P.content_key(F.col("title"), F.col("employer"), F.col("city"))})


def sightings(normalised: DataFrame) -> DataFrame:
    """Every collection of a posting, once: unique by (job_id, fetched_at); of repeats the least key and role hold."""
    m = F.min(F.struct("dedup_key", "search_role", "search_location", "ingest_date")).alias("m")
    return normalised.groupBy("job_id", "fetched_at").agg(m).select("job_id", "m.dedup_key", "m.search_role", "m.search_location", "fetched_at", "m.ingest_date")


def occupations(snapshots: DataFrame) -> DataFrame:
    """The latest snapshot of each occupation; ties by reference year, then employment."""
    from quarrymill.operators.relational import latest_per_key

    r = snapshots.select(F.to_timestamp("fetched_at").alias("fetched_at"), F.explode("records").alias("r")).select("r.*", "fetched_at")
    return latest_per_key(r, ["occupation_code"], "fetched_at", [F.col("reference_year").desc_nulls_last(), F.col("total_employment").desc_nulls_last()])


SUPPRESSED = ("*", "**", "#")
SHEET_COLUMNS = ("OCC_CODE", "OCC_TITLE", "O_GROUP", "TOT_EMP", "A_MEDIAN")


def sheet_rows(rows: DataFrame, year: int) -> DataFrame:
    """Detailed rows of an occupation sheet; suppressed figures are null. A missing column is an error."""
    missing = [c for c in SHEET_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"the sheet lacks {missing}")

    def figure(c: str) -> Column:
        text = F.trim(F.col(c).cast("string"))
        return F.when(~text.isin(*SUPPRESSED), F.regexp_replace(text, ",", "").cast("double").cast("long"))

    return rows.where(F.col("O_GROUP") == "detailed").select(F.col("OCC_CODE").alias("occupation_code"), F.col("OCC_TITLE").alias("title"), figure("TOT_EMP").alias("total_employment"), figure("A_MEDIAN").alias("median_wage"), F.lit(year).alias("reference_year"))


def pages(fetch: Callable[[str | None], tuple[list[dict], str | None]], most: int) -> Iterator[list[dict]]:
    """Pages of a cursor API until an empty page, no cursor, or `most` pages."""
    cursor = None
    for _ in range(most):
        rows, cursor = fetch(cursor)
        if not rows:
            return
        yield rows
        if not cursor:
            return


#: States of an HTTP answer after which a request is tried again.
RETRIED = (429, 500, 502, 503, 504)


class HttpError(OSError):
    """An answer with a state other than success."""

    def __init__(self, status: int):
        super().__init__(f"HTTP {status}")
        self.status = status


def checked_status(status: int) -> None:
    """Raises for an answer that isn't a success; `retried` tries again after those of RETRIED only."""
    if status >= 400:
        raise HttpError(status)


def sheet_of_archive(data: bytes) -> list[dict]:
    """The rows of the only .xlsx of a zip archive, as text by the header's names; no or several sheets files, or a missing column, are an error."""
    import io
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        books = [n for n in z.namelist() if n.lower().endswith(".xlsx")]
        if len(books) != 1:
            raise ValueError(f"one .xlsx expected, {len(books)} found")
        with zipfile.ZipFile(io.BytesIO(z.read(books[0]))) as x:
            ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
            shared = []
            if "xl/sharedStrings.xml" in x.namelist():
                shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(x.read("xl/sharedStrings.xml")).findall("m:si", ns)]
            rows = []
            for r in ElementTree.fromstring(x.read("xl/worksheets/sheet1.xml")).iter(f"{{{ns['m']}}}row"):
                cells = {}
                for c in r.findall("m:c", ns):
                    v, inline = c.find("m:v", ns), c.find("m:is", ns)
                    text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")) if inline is not None else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                    cells["".join(ch for ch in c.get("r", "") if ch.isalpha())] = text
                rows.append(cells)
    if not rows:
        raise ValueError("the sheet is empty")
    header = rows[0]
    missing = [c for c in SHEET_COLUMNS if c not in header.values()]
    if missing:
        raise ValueError(f"the sheet lacks {missing}")
    return [{header[k]: r.get(k) for k in header} for r in rows[1:]]


def read_relational(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None) -> DataFrame:
    """A query's result from a database; one more try after a failure, and decimals as doubles."""
    df = retried(lambda: spark.read.format("jdbc").options(url=url, query=query, **(properties or {})).load(), times=1, transient=(Exception,))
    return without_decimals(df)


def without_decimals(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def retried(call: Callable, times: int = 3, wait: float = 1.0, transient: tuple[type[Exception], ...] = (OSError,)):
    """`call()` with `times` retries after transient errors, waiting twice as long each time."""
    import time

    for k in range(times + 1):
        try:
            return call()
        except transient as e:
            if k == times or isinstance(e, HttpError) and e.status not in RETRIED:
                raise
            time.sleep(wait * 2**k)


class PagedSource(DataSource):
    """spark.read.format("paged_postings") over a module-level page function: options module, function, pages, and pairs "role;place|role;place"."""

    @classmethod
    def name(cls) -> str:
        return "paged_postings"

    def schema(self) -> str:
        return f"role string, location string, {JOB}"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(schema, self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(tuple(p.split(";"))) for p in self.options["pairs"].split("|")]

    def read(self, partition: InputPartition):
        import importlib

        role, place = partition.value
        fetch = getattr(importlib.import_module(self.options["module"]), self.options["function"])
        for rows in pages(lambda cursor: retried(lambda: fetch(role, place, cursor)), int(self.options.get("pages", 3))):
            for r in rows:
                yield tuple({"role": role, "location": place, **r}.get(f.name) for f in self.schema.fields)


def first_available(fetch: Callable[[int], bytes | None], year: int, back: int = 2) -> tuple[int, bytes]:
    """The latest published year's file: the year before `year`, else the one before that."""
    for y in range(year - 1, year - 1 - back, -1):
        got = fetch(y)
        if got is not None:
            return y, got
    raise LookupError(f"nothing published for the {back} years before {year}")


def pdf_text(data: bytes, most: int = 10) -> str:
    """Text of the first pages of a PDF, if the optional reader is installed; a file without text is an error."""
    import io

    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF needs pdfplumber") from e
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        text = "\n".join(p.extract_text() or "" for p in pdf.pages[:most]).strip()
    if not text:
        raise ValueError("the PDF holds no text")
    return text
