"""Import side effect: every module that registers queries into the catalog."""

from . import catalog  # noqa: F401
from . import catalog_questions  # noqa: F401
from . import catalog_vectors  # noqa: F401
from . import catalog_changes  # noqa: F401
from . import catalog_history  # noqa: F401
from . import catalog_io  # noqa: F401
