"""Reading and writing of events, operational tables and the station reference."""
