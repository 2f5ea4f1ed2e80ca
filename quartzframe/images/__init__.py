"""Per-image stages over binary columns, behind one mapInArrow interface."""
