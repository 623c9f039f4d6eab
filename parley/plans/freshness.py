"""What to run before a search."""

from __future__ import annotations

#: In order: the condition, whether to sync and to index, and why.  The first that holds decides.
ADVICE = (
    ("never_synced", True, None, "nothing has been synced into this archive yet"),
    ("corrupt", False, True, "the vector index can't be read ({corrupt})"),
    ("never_indexed", False, True, "no vector index has been built yet"),
    ("no_archive", True, True, "the tables that the index was built from are gone"),
    ("unreadable", False, True, "the archive can't be compared with the index ({revision_error})"),
    ("behind", False, True, "windows have changed since the index was built"),
    ("fine", False, False, "nothing is known to be out of date"),
)


def recommendation(synced: bool, indexed: bool, corrupt: str | None = None, archive_present: bool = True, revision_equal: bool | None = None, revision_error: str | None = None) -> dict:
    """The row of ADVICE for the last sync, the last index and the revisions."""
    holds = {
        "never_synced": not synced, "corrupt": bool(corrupt), "never_indexed": not indexed, "no_archive": not archive_present,
        "unreadable": bool(revision_error), "behind": revision_equal is False, "fine": True,
    }
    _, sync, index, reason = next(row for row in ADVICE if holds[row[0]])
    reason = reason.format(corrupt=corrupt, revision_error=revision_error)
    return {"sync_before_search": sync, "index_before_semantic_search": not indexed if index is None else index, "reason": reason}
