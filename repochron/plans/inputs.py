"""Frames that several registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repochron.operators import ci, documents, manifests, technology
from repochron.operators import commits as K
from repochron.operators.study import Study
from repochron.plans.corpus import Corpus
from repochron.session import stage  # noqa: F401


#: one study per application and directory; its shared tables are written on first use
_STUDIES: dict[tuple[str, str], Study] = {}


def summaries(c: Corpus) -> DataFrame:
    return c.table("summaries", lambda: K.commit_summaries(c.commits(), c.changes()))


def people(c: Corpus) -> DataFrame:
    return K.people(summaries(c))


def read_documents(c: Corpus) -> DataFrame:
    return c.table("documents", lambda: documents.documents(c.files(), c.blobs()))


def ordered_manifests(c: Corpus) -> DataFrame:
    return c.table("manifests", lambda: manifests.ordered_manifests(manifests.manifest_facts(read_documents(c))))


def ci_steps(c: Corpus) -> DataFrame:
    return c.table("ci_steps", lambda: ci.ci_steps(read_documents(c), ci.root_scripts(ordered_manifests(c))))


def marker_history(c: Corpus) -> DataFrame:
    return c.table("marker_history", lambda: technology.marker_history(c.commits(), c.changes(), c.files()))


def study(c: Corpus) -> Study:
    key = (c.spark.sparkContext.applicationId, c.dir)
    if key not in _STUDIES:
        _STUDIES[key] = Study(
            repos=c.repos(), commits=c.commits(), changes=c.changes(), tags=c.tags(), files=c.files(), blobs=c.blobs(), events=c.session_events(), staged=True)
    return _STUDIES[key]


def period_members(c: Corpus) -> DataFrame:
    """Commits by people grouped by two-year periods: given groups for the group-level checks.

    The numbers ``milestone`` follow the calendar, so SQL can rebuild them.
    """
    riding = K.with_riding(people(c), c.tags())
    period = F.floor((F.substring("authored_date", 1, 4).cast("int") - 1990) / 2).cast("long")
    return c.table("period_members", lambda: riding.withColumn("milestone", period))


def joined(column: str, separator: str = "; ") -> F.Column:
    return F.array_join(column, separator)
