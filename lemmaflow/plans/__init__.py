"""The registered queries."""

from lemmaflow.plans import registry  # noqa: F401, I001
from lemmaflow.plans import formulas, datasets, encodings, requests, sessions  # noqa: F401, I001
