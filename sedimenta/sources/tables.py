"""Declarations of the staged tables: files, columns, parsers, keys, parents.

A ``TableSpec`` turns split fields into typed columns by name; a column missing in the header is null and an
extra one is ignored. Only the identifying column can reject a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.functions import scalars


@dataclass(frozen=True)
class Grain:
    """What a row of a table stands for, and whether that is promised to be unique."""

    key: tuple[str, ...]
    unique: bool


@dataclass(frozen=True)
class TableSpec:
    table: str
    delimiter: str
    partition: str
    members: str
    identity: str
    columns: tuple[tuple[str, str], ...]
    header: tuple[str, ...] | None = None

    @property
    def names(self) -> list[str]:
        out = [self.partition]
        for name, kind in self.columns:
            out += [f"{name}_raw", f"{name}_prec", name] if kind == "partial" else [name]
        return out

    def build(self, field) -> list[Column]:
        """Typed columns; ``field(name)`` is the trimmed text of a column, null if empty."""
        out: list[Column] = []
        for name, kind in self.columns:
            raw = field(name)
            if kind == "partial":
                text, prec, exact = scalars.partial_date(raw, clean=True)
                out += [text.alias(f"{name}_raw"), prec.alias(f"{name}_prec"), exact.alias(name)]
            else:
                out.append(PARSERS[kind](raw).alias(name))
        return out

    def identity_problem(self, field) -> Column:
        """Why the identifying column rejects the row, else null."""
        raw = field(self.identity)
        if dict(self.columns)[self.identity] in ("bigint", "int"):
            shown = F.coalesce(F.concat(F.lit("'"), raw, F.lit("'")), F.lit("None"))
            return F.when(scalars.integer(raw, clean=True).isNull(), F.concat(F.lit(f"{self.identity}="), shown, F.lit(" is not an integer")))
        return F.when(raw.isNull(), F.lit(f"{self.identity} is empty"))


PARSERS = {
    "string": lambda c: c,
    "bigint": lambda c: scalars.integer(c, clean=True),
    "int": lambda c: scalars.integer(c, clean=True).try_cast("int"),
    "double": lambda c: scalars.number(c, clean=True),
    "boolean": lambda c: scalars.boolean(c, clean=True),
    "date": lambda c: scalars.iso_date(c, clean=True),
    "timestamp": lambda c: scalars.iso_timestamp(c, clean=True),
}


# ---------------------------------------------------------------- fixed values: layouts of the public extracts, (column, kind)

DEMO = (
    ("primaryid", "bigint"),
    ("caseid", "bigint"),
    ("caseversion", "int"),
    ("i_f_code", "string"),
    ("event_dt", "partial"),
    ("mfr_dt", "partial"),
    ("init_fda_dt", "partial"),
    ("fda_dt", "partial"),
    ("rept_cod", "string"),
    ("auth_num", "string"),
    ("mfr_num", "string"),
    ("mfr_sndr", "string"),
    ("lit_ref", "string"),
    ("age", "string"),
    ("age_cod", "string"),
    ("age_grp", "string"),
    ("sex", "string"),
    ("e_sub", "string"),
    ("wt", "string"),
    ("wt_cod", "string"),
    ("rept_dt", "partial"),
    ("to_mfr", "string"),
    ("occp_cod", "string"),
    ("reporter_country", "string"),
    ("occr_country", "string"),
)
DRUG = (
    ("primaryid", "bigint"),
    ("caseid", "bigint"),
    ("drug_seq", "int"),
    ("role_cod", "string"),
    ("drugname", "string"),
    ("prod_ai", "string"),
    ("val_vbm", "string"),
    ("route", "string"),
    ("dose_vbm", "string"),
    ("cum_dose_chr", "string"),
    ("cum_dose_unit", "string"),
    ("dechal", "string"),
    ("rechal", "string"),
    ("lot_num", "string"),
    ("exp_dt", "partial"),
    ("nda_num", "string"),
    ("dose_amt", "string"),
    ("dose_unit", "string"),
    ("dose_form", "string"),
    ("dose_freq", "string"),
)
REAC = (
    ("primaryid", "bigint"),
    ("caseid", "bigint"),
    ("pt", "string"),
    ("drug_rec_act", "string"),
)
OUTC = (
    ("primaryid", "bigint"),
    ("caseid", "bigint"),
    ("outc_cod", "string"),
)
RPSR = (
    ("primaryid", "bigint"),
    ("caseid", "bigint"),
    ("rpsr_cod", "string"),
)
THER = (
    ("primaryid", "bigint"),
    ("caseid", "bigint"),
    ("dsg_drug_seq", "int"),
    ("start_dt", "partial"),
    ("end_dt", "partial"),
    ("dur", "string"),
    ("dur_cod", "string"),
)
INDI = (
    ("primaryid", "bigint"),
    ("caseid", "bigint"),
    ("indi_drug_seq", "int"),
    ("indi_pt", "string"),
)
STUDIES = (
    ("nct_id", "string"),
    ("study_type", "string"),
    ("overall_status", "string"),
    ("last_known_status", "string"),
    ("phase", "string"),
    ("enrollment", "int"),
    ("enrollment_type", "string"),
    ("source", "string"),
    ("source_class", "string"),
    ("acronym", "string"),
    ("brief_title", "string"),
    ("official_title", "string"),
    ("why_stopped", "string"),
    ("number_of_arms", "int"),
    ("number_of_groups", "int"),
    ("has_dmc", "boolean"),
    ("is_fda_regulated_drug", "boolean"),
    ("is_fda_regulated_device", "boolean"),
    ("start_date", "date"),
    ("start_date_type", "string"),
    ("completion_date", "date"),
    ("completion_date_type", "string"),
    ("primary_completion_date", "date"),
    ("primary_completion_date_type", "string"),
    ("study_first_submitted_date", "date"),
    ("study_first_posted_date", "date"),
    ("last_update_submitted_date", "date"),
    ("last_update_posted_date", "date"),
    ("results_first_posted_date", "date"),
    ("updated_at", "timestamp"),
)
SPONSORS = (
    ("id", "bigint"),
    ("nct_id", "string"),
    ("agency_class", "string"),
    ("lead_or_collaborator", "string"),
    ("name", "string"),
)
CONDITIONS = (
    ("id", "bigint"),
    ("nct_id", "string"),
    ("name", "string"),
    ("downcase_name", "string"),
)
INTERVENTIONS = (
    ("id", "bigint"),
    ("nct_id", "string"),
    ("intervention_type", "string"),
    ("name", "string"),
    ("description", "string"),
)
FACILITIES = (
    ("id", "bigint"),
    ("nct_id", "string"),
    ("status", "string"),
    ("name", "string"),
    ("city", "string"),
    ("state", "string"),
    ("zip", "string"),
    ("country", "string"),
    ("latitude", "double"),
    ("longitude", "double"),
)


@dataclass(frozen=True)
class Extract:
    """A table of an extract: its columns, where it lies, and what tells its rows apart below the identifying column."""

    table: str
    member: str
    columns: tuple[tuple[str, str], ...]
    identity: str
    below: tuple[str, ...] = ()
    parent: tuple[str, str] | None = None  # the parent table and the column that names its row


_OF_REPORT, _OF_STUDY = ("faers_demo", "primaryid"), ("aact_studies", "nct_id")
CASE_REPORTS = (
    Extract("faers_demo", "DEMO", DEMO, "primaryid"),
    Extract("faers_drug", "DRUG", DRUG, "primaryid", ("drug_seq",), _OF_REPORT),
    Extract("faers_reac", "REAC", REAC, "primaryid", ("pt",), _OF_REPORT),
    Extract("faers_outc", "OUTC", OUTC, "primaryid", ("outc_cod",), _OF_REPORT),
    Extract("faers_rpsr", "RPSR", RPSR, "primaryid", ("rpsr_cod",), _OF_REPORT),
    Extract("faers_ther", "THER", THER, "primaryid", ("dsg_drug_seq",), _OF_REPORT),
    Extract("faers_indi", "INDI", INDI, "primaryid", ("indi_drug_seq", "indi_pt"), _OF_REPORT),
)
STUDY_TABLES = (
    Extract("aact_studies", "studies", STUDIES, "nct_id"),
    Extract("aact_sponsors", "sponsors", SPONSORS, "id", (), _OF_STUDY),
    Extract("aact_conditions", "conditions", CONDITIONS, "id", (), _OF_STUDY),
    Extract("aact_interventions", "interventions", INTERVENTIONS, "id", (), _OF_STUDY),
    Extract("aact_facilities", "facilities", FACILITIES, "id", (), _OF_STUDY),
)


def case_report_specs(quarter: str) -> list[TableSpec]:
    """Specs of one quarter like ``2025Q1``, the parent table first, the headerless deletion list second."""
    tag = quarter[2:]
    first, *rest = [TableSpec(x.table, "$", "quarter", f"ASCII/{x.member}{tag}.txt", x.identity, x.columns) for x in CASE_REPORTS]
    deleted = TableSpec("faers_deleted_case", "$", "quarter", f"Deleted/DELETE{tag}.txt;Deleted/DELETED{tag}.txt", "caseid", (("caseid", "bigint"),), header=("caseid",))
    return [first, deleted, *rest]


def study_specs() -> list[TableSpec]:
    return [TableSpec(x.table, "|", "snapshot", f"{x.member}.txt", x.identity, x.columns) for x in STUDY_TABLES]


def spec_of(table: str, period: str = "2099Q1") -> TableSpec:
    return next(s for s in [*case_report_specs(period), *study_specs()] if s.table == table)


# ---------------------------------------------------------------- keys, parents and partial dates, out of the layouts


def _grains() -> dict[str, Grain]:
    """A table repeats by its period, its identifying column and what lies below it; with nothing below, that is unique."""
    out = {"faers_case_current": Grain(("caseid",), True)}
    for spec, extract in [*((s, x) for s in case_report_specs("2099Q1") for x in CASE_REPORTS if x.table == s.table), *zip(study_specs(), STUDY_TABLES)]:
        out[spec.table] = Grain((spec.partition, extract.identity, *extract.below), not extract.below)
    return out | {"faers_deleted_case": Grain(("quarter", "caseid"), True)}


GRAINS = _grains()
PARENTS = {x.table: (x.parent[0], (period, x.parent[1])) for period, tables in (("quarter", CASE_REPORTS), ("snapshot", STUDY_TABLES)) for x in tables if x.parent}
PARTIAL_DATES = tuple((x.table, c) for x in CASE_REPORTS for c, kind in x.columns if kind == "partial" and c not in ("mfr_dt", "init_fda_dt", "rept_dt"))
