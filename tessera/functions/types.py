"""Names for arguments that may be left out."""

from __future__ import annotations

Text = str | None
Number = int | None
