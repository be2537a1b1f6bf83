"""shardwise: sharded training-data preparation and checks as Spark DataFrame jobs."""

from .functions.rowindex import with_csv_row_index, with_parquet_row_index, with_row_index
from .operators.manifest import attach_uris, count_objects, make_manifest, manifest_totals, partition_counts
from .operators.shards import assign_shards, read_spec, resolve_sizes, shard, slice_rows
from .operators.stats import sample_vs_population, summarize, summary_wide, zscores, zscores_by_group
from .plans.dataset import ShardedDataset
from .session import ensure_checkpoint_dir, get_session, scale_conf

__all__ = [
    "ShardedDataset", "assign_shards", "attach_uris", "count_objects", "ensure_checkpoint_dir",
    "get_session", "make_manifest", "manifest_totals", "partition_counts", "read_spec",
    "resolve_sizes", "sample_vs_population", "scale_conf", "shard", "slice_rows", "summarize",
    "summary_wide", "with_csv_row_index", "with_parquet_row_index", "with_row_index", "zscores",
    "zscores_by_group",
]
__version__ = "0.1.0"
