"""Named queries; importing this package registers all of them."""

from . import queries_intervals  # noqa: F401
from . import queries_windows  # noqa: F401
from . import queries_matching  # noqa: F401
from . import queries_graph  # noqa: F401
from . import queries_stats  # noqa: F401
from . import queries_joins  # noqa: F401
from . import queries_io  # noqa: F401
from . import queries_more  # noqa: F401
