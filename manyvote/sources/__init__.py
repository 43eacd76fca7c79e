"""Reading inputs and writing predictions."""

from manyvote.sources.sinks import read_predictions, write_predictions
from manyvote.sources.tabular import fold_pairs, read_fold, read_table

__all__ = ["fold_pairs", "read_fold", "read_predictions", "read_table", "write_predictions"]
