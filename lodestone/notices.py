"""Notices about searches that work but cost much; `enabled` turns them off."""

from __future__ import annotations

import logging

log = logging.getLogger("lodestone")
enabled = True


def warn(model_name: str, message: str) -> None:
    if enabled:
        log.warning("%s: %s", model_name, message)
