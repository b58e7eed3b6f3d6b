"""Jobs with a command line: the work is a function of a session, which only the command line creates and stops."""
