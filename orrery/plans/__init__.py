"""SQL over registered frames, and a look at plans."""
