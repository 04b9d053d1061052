"""Readers and writers of gridded stores, statistics tables and skill tables."""

from .ensembles import read_members, stored_members, write_members
from .ingest import Ingested, ingest, read_store
from .stores import (
    extract_toy,
    load_stats,
    merge_static,
    pending_files,
    read_bucketed,
    read_grid,
    read_raw,
    read_skills,
    relayout,
    round_on_write,
    save_stats,
    write_bucketed,
    write_grid,
)

__all__ = [
    "Ingested", "extract_toy", "ingest", "load_stats", "merge_static", "pending_files", "read_bucketed", "read_grid", "read_members", "read_raw",
    "read_skills", "read_store", "relayout", "round_on_write", "save_stats", "stored_members", "write_bucketed", "write_grid", "write_members",
]
