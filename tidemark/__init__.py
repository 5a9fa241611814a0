"""Time-series record analytics on PySpark."""

from .datastore import Datastore, ErrorEvent, QueryEngineModule, run_query_with_engine
from .errors import *  # noqa: F403
from .functions.ordering import compare_by_logical_order, to_public_record
from .functions.validation import clone_payload, encoded_bytes, epoch_ms
from .languages import LuceneEngine, SqlEngine
from .plans.compiler import execute, select_range
from .plans.request import Aggregate, And, Comparison, ExecutionOptions, Not, Or, OrderBy, Projection, QueryLimits, QueryRequest, options_from, request_from
from .sources.records import PayloadView, TableView

__all__ = [
    "Aggregate", "And", "Comparison", "Datastore", "ErrorEvent", "ExecutionOptions", "LuceneEngine", "Not", "Or", "OrderBy", "PayloadView", "Projection", "QueryEngineModule", "QueryLimits",
    "QueryRequest", "SqlEngine", "TableView", "clone_payload", "compare_by_logical_order", "encoded_bytes", "epoch_ms", "execute", "options_from", "request_from", "run_query_with_engine", "select_range", "to_public_record",
]
