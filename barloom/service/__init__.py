"""Around the engine: experiments, reports, checks of user code, commands."""
