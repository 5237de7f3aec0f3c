"""From text to statements, and the schemas that they are bound to."""
