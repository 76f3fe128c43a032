"""Dataset audit, retrieval and curation as Spark jobs."""

from siftwork.corpus import Corpus
from siftwork.operators.selection import Selection
from siftwork.session import get_session, reliable_checkpoint

__all__ = ["Corpus", "Selection", "get_session", "reliable_checkpoint"]
