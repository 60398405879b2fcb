from numerale.sources.lines import accepted, parse_csv_lines, parse_json_lines, rejected
from numerale.sources.observations import (
    as_series,
    parse_time,
    read_observations,
    read_predictions,
    rejected_observations,
    rejected_times,
    rejected_values,
)
from numerale.sources.responses import explode_logprobs, gather_logprobs, read_completions, read_token_logprobs
from numerale.sources.sinks import write_bucketed, write_table
from numerale.sources.tables import (
    lineitem_by_supplier,
    load,
    orders_by_priority,
    orders_by_nation,
)

__all__ = [
    "accepted", "parse_csv_lines", "parse_json_lines", "rejected", "write_bucketed",
    "as_series", "parse_time", "read_observations", "read_predictions",
    "rejected_observations", "rejected_times", "rejected_values",
    "explode_logprobs", "gather_logprobs", "read_completions", "read_token_logprobs", "write_table",
    "lineitem_by_supplier", "load", "orders_by_priority", "orders_by_nation",
]
