"""Sources: text files, lines at hand, the syslog stream and the default pattern library."""

from ..engine import default_patterns
from ..operators.framing import messages_from_lines, read_messages
from ..streaming.syslog import NAME as SYSLOG_FORMAT
from ..streaming.syslog import register as register_syslog

__all__ = ["SYSLOG_FORMAT", "default_patterns", "messages_from_lines", "read_messages", "register_syslog"]
