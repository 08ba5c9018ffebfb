"""Text and binary forms of geometry."""
