"""Plan helpers: durable cut points and partition counts."""
