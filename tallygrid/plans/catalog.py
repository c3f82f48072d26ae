"""All registered queries."""
from tallygrid.plans.registry import QUERIES, SQL  # noqa: F401
from tallygrid.plans import q_blend, q_docs, q_documents, q_grid, q_quality, q_scalars, q_select, q_store  # noqa: F401
