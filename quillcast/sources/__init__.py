"""Sources and sinks: JSON lines and objects, sharded and dated layouts, upserts and lookups."""

from .bucket_table import BucketTable  # noqa: F401
from .json import append_json_lines, read_file_per_record, read_json_document, read_json_lines, read_json_lines_strict, write_json_lines  # noqa: F401
from .stamps import stamped, stamps  # noqa: F401
from .tables import index_terms, latest_per_key, month_of, read_shard, shard_of, upsert, write_by_month, write_shards  # noqa: F401
from .text_index import TextIndex  # noqa: F401
from .vector_index import VectorIndex  # noqa: F401
from .warc import articles_of, read_warc, write_warc  # noqa: F401
