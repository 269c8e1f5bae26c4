"""DataFrame operators over criteria, trials, attempts and terminology."""
