"""Column-level building blocks: no joins, no shuffles, all inside codegen."""
