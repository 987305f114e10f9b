"""Financial document records analytics, planned by Catalyst."""
