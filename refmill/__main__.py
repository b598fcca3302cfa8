from refmill.cli import main

main()
