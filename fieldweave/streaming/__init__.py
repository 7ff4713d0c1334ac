"""Out-of-core runs: a stored field in, a stored field out, with statistics on the way."""

from fieldweave.streaming.measure import Measures, measured
from fieldweave.streaming.run import run_to_store, stream_execute
from fieldweave.streaming.slabs import run_in_slabs
from fieldweave.streaming.sweeps import sweep
