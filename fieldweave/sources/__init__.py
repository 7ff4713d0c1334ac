"""Reading and writing fields."""

from fieldweave.sources.store import ingest, load_field, open_field, save_field  # noqa: F401
from fieldweave.sources.tiles import decompose_field, tiles  # noqa: F401
