from attrix.sources.fixtures import (ASSESSMENT_COLUMNS, INCIDENT_COLUMNS, ORDERATOM_COLUMNS,
                                    TICKET_COLUMNS, VIEW_COLUMNS, load_view, read_table)
from attrix.sources.jdbc import read_jdbc_query
from attrix.sources.models import load_model, model_path, save_model

__all__ = [
    "ASSESSMENT_COLUMNS", "INCIDENT_COLUMNS", "ORDERATOM_COLUMNS", "TICKET_COLUMNS", "VIEW_COLUMNS",
    "load_view", "read_table", "read_jdbc_query", "load_model", "model_path", "save_model",
]
